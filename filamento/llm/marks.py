"""What counts as markup of HTML, Markdown, wiki and LaTeX."""

from __future__ import annotations

import html
import re

# Element names of HTML and of the filing editors' dialect (dashes and digits may follow).
ELEMENTS = (
    "a abbr acronym address article aside b base big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em fieldset "
    "figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript "
    "object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea "
    "tfoot th thead time title tr tt u ul var video wbr table-group section-1 section-2 section-3 library document company-name document-name pgbrk tu te extraction"
).split()
# Entity names that occur without a standard meaning.
OWN_ENTITIES = ("cr",)
NAMED = {n.rstrip(";") for n in html.entities.html5} | set(OWN_ENTITIES)

_NAME = "|".join(sorted(map(re.escape, ELEMENTS), key=len, reverse=True))
TAG = re.compile(rf"</?(?:{_NAME})(?=[\s/>&'*`~$\\])[^<>]*>|</(?:{_NAME})\s*>|<!--|-->|<!DOCTYPE|<\?xml|<!\[CDATA\[", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));|&cr(?![A-Za-z0-9])")
#: A placeholder of a form (another operator's business), blanked out before markup is sought.
FORM = re.compile(r"<%=?.*?%>|\$\{[^{}\n]*\}|\{\{[^{}|\n]*\}\}|\[\[[^\[\]|\n]*\(를\)[^\[\]\n]*\]\]|@@[A-Z0-9_.]+@@|\d+#\*_|_{2,}년?|◆click◆")
MARKDOWN = re.compile(
    r"(?m)\*\*(?=\S)[^*\n]+?\*\*|__(?=[^\s_])[^_\n]+?__(?![\w_])|~~(?=\S)[^~\n]+?~~|`[^`\n]+`|^\s{0,3}(?:```|~~~)|^\s{0,3}#{1,6}[ \t]+\S|!?\[[^\[\]\n]*\]\((?:[^()\s]+|#[^()\s]*)\)"
    r"|^\s{0,3}\|?\s*:?-{3,}:?\s*\|[-:|\s]*$|^\s*\|.+\|.+\|\s*$|^\s{0,3}>[ \t]+\S|^\s*[-*+] \[[ xX]\] |^\s{0,3}(?:\* \* \*|\*{3,}|={4,}|-{4,})\s*$|(?<![\w*])\*(?=[^\s*\d])[^*\n]{1,80}?(?<=[^\s*])\*(?![\w*])"
)
WIKI = re.compile(r"(?m)'''?(?=\S)[^'\n]+?'''?|^\s*={2,6}[ \t]*[^=\n]+?[ \t]*={2,6}\s*$|\[\[[^\[\]\n]+\]\]|^\s*\{\||^\s*\|\}|^\s*\|-|^\s*![^!\n]+!!|\[https?://\S+ [^\]\n]+\]|\{\{[^{}\n]*\|[^{}\n]*\}\}|^\s*\*{2,} |^h[1-6]\. |<ref\b|__[A-Z]{3,}__")
LATEX = re.compile(r"\\(?:[a-zA-Z]{2,}\*?(?=[\s{\\\[\^_()$.,;:!~]|$|[^\x00-\x7f])|[%&#_{}$])|\\\(|\\\)|\\\[|\\\]|\$\$|(?<![\w$\\])\$(?=[^\s$\d])[^$\n]{1,200}?(?<=\S)\$(?!\d)|(?<![\w$\\])\$\d[^$\n]{0,60}[\\^_][^$\n]{0,60}\$")
#: Characters without which none of the patterns can match: the cheapest test.
SIGNS = re.compile(r"[<>&*_~`#\[\]|'={}\\$]|-{3}|!!|^h[1-6]\. ", re.M)


def entity(text: str) -> bool:
    for m in ENTITY.finditer(text):
        if m[1] is None or m[1] in NAMED:
            return True
    return False


def counts(text: str) -> tuple[int, int, int, int]:
    """Signs of HTML, Markdown, wiki and LaTeX in a text, form placeholders left out of account."""
    if not text or not SIGNS.search(text):
        return 0, 0, 0, 0
    t = FORM.sub(" ", text)
    html_ = len(TAG.findall(t)) + (sum(m[1] is None or m[1] in NAMED for m in ENTITY.finditer(t)) if "&" in t else 0)
    return html_, len(MARKDOWN.findall(t)), len(WIKI.findall(t)), len(LATEX.findall(t)) if "\\" in t or "$" in t else 0


def kinds(text: str) -> list[str]:
    """Names of the markup languages found in a text, form placeholders left out of account."""
    if not text or not SIGNS.search(text):
        return []
    t = FORM.sub(" ", text)
    found = []
    if TAG.search(t) or ("&" in t and entity(t)):
        found.append("html")
    if MARKDOWN.search(t):
        found.append("markdown")
    if WIKI.search(t):
        found.append("wiki")
    if ("\\" in t or "$" in t) and LATEX.search(t):
        found.append("latex")
    return found


_OWN = re.compile(r"<!--.*?(?:-->|$)|<(style|script)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_ANY_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*|/)?>|<!DOCTYPE[^>]*>|<\?[^>]*>", re.I)
_BREAKS = {"br", "p", "div", "tr", "td", "th", "li", "table", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "section", "caption", "blockquote"}


def _gap(m: re.Match) -> str:
    name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", m[0])
    return "\n" if name and name[1].lower() in _BREAKS else ""


def unescape_once(text: str) -> str:
    return html.unescape(re.sub(r"&cr;?(?![A-Za-z0-9])", "\n", text)) if "&" in text else text


def visible(source: str) -> str:
    """Visible text of an HTML value: its own tags, comments, styles and entities resolved once."""
    return unescape_once(_ANY_TAG.sub(_gap, _OWN.sub(" ", source)))
