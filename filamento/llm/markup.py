"""Markup residue and clean text with its structure kept.

A value is cut into flat text blocks. Each block has a word count, a link density and counts of markup
signs by language, and knows those of its neighbours; a decision tree trained on a small labelled table
calls it content, residue or boilerplate. The tree alone decides: values with a block that is no content
are the cases, residue blocks are rendered, boilerplate blocks (nothing but links) are left out of clean
texts, and content blocks stay as they are.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filamento.functions.udf import arrow
from filamento.llm import marks
from filamento.llm.cart import Tree

LINK = re.compile(r"<a\b[^>]*>(.{0,400}?)</a>|!?\[([^\[\]\n]*)\]\([^()\n]*\)|\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", re.I | re.S)

# The labelled table, one block a line: label, a bar, the block. Invented lines; neighbours are the lines around.
LABELLED = r"""
content|회사는 소라 공장에서 단추를 만들고 있습니다.
content|매출은 전기보다 늘었으며 재고는 줄었습니다.
content|R&D 조직은 새 소재를 맡습니다.
residue|매출은 <b>전기보다</b> 늘었습니다.
content|A등급은 A*에서 B*로 바뀌었습니다.
residue|당기 **매출액**은 늘었습니다.
residue|늘었습니다.&nbsp;&nbsp; 다만 비용은 줄었습니다.
content|단가는 US$ 10에서 US$ 20 사이입니다.
residue|비율은 $\frac{a}{b}$ 입니다.
content|시험은 3 < x 이고 y > 5 인 구간에서 하였습니다.
residue|# 사업 개요
content|#2 라인을 고쳤습니다.
residue|== 사업 개요 ==
residue|[[단추|소라 공장]] 자료를 보십시오.
content|[단위 : 백만원]
content|- 단추 12개
residue|- 단추 `코드` 12개
content|합계
content|12,345
content|(주1)
residue|```
content|x = 3 * y
residue|```
content|표 <3>의 금액은 별도 기준입니다.
residue|<!-- 표 시작 -->표의 금액은 별도 기준입니다.
residue|{| class="wikitable"
residue|! 구분 !! 당기
residue||}
content|{주석 3} 참조 표시는 없습니다.
residue|\section{개요} 회사는 단추를 만듭니다.
residue|~~2018년~~ 1월에 나올 예정입니다.
residue|'''단추''' 사업을 따로 관리합니다.
residue|비용은&cr 줄었습니다.
residue|![그림](img_1.png)
residue|<span class='a'>단추
residue|</td></tr>
content|『백서』에 실린 통계입니다.
content|1. 단추 사업 ........... 12
residue|| 구분 | 당기 |
residue||---|---:|
content|도면 소라_3_B 계열입니다.
residue|수식은 \(a + b\) 입니다.
content|Q&A 자료와 M&A 자료가 있습니다.
content|값은 90 < 95 입니다.
boilerplate|<a href="/">처음</a> <a href="/b">다음</a>
boilerplate|<a href="/c">목록</a>
boilerplate|<a href="/d">위로</a> <a href="/e">아래로</a> <a href="/f">끝</a>
boilerplate|<a href="/x">이전</a> | <a href="/y">다음</a> | <a href="/z">인쇄</a>
boilerplate|[처음](/a) [목록](/b) [다음](/c)
residue|<a href="/r">회사가 지난해에 새로 지은 공장의 생산 능력과 가동률을 설명한 긴 글입니다.</a>
residue|[회사가 지난해에 새로 지은 공장의 생산 능력과 가동률을 설명한 긴 글입니다.](/s)
residue|자료는 <a href="/g">여기</a>에 실린 긴 본문을 보십시오.
content|매입단가는 톤당 981원이며 판매 계획은 다음 해에 다시 정합니다.
residue|매입단가는 <i>톤당</i> 981원이며 판매 계획은&middot; 다시 정합니다.
residue|[[감사인|사업부]] 매출 12 **굵게**
content|매출총이익 34
"""


#: In flat blocks of rendered HTML, link texts stand between these.
LINK_ON, LINK_OFF = "\x01", "\x02"


def features(lines: list[str]) -> list[tuple]:
    """Per block: words, link density, signs by language; of the block before and the one after, words,
    link density and all signs."""
    base = []
    for s in lines:
        n = len(s)
        links = 0
        if LINK_ON in s:
            links = sum(map(len, re.findall(f"{LINK_ON}([^{LINK_OFF}]*)", s)))
            s = s.replace(LINK_ON, "").replace(LINK_OFF, "")
            n = len(s.strip())
        elif "[" in s or "<" in s:
            links = sum(len(m[0]) for m in LINK.finditer(marks.FORM.sub(" ", s)))
        base.append((s.count(" ") + 1 if n else 0, links / n if n else 0.0, *marks.counts(s)))
    none = (0, 0.0, 0)
    around = [(b[0], b[1], sum(b[2:])) for b in base]
    return [(*b, *(around[i - 1] if i else none), *(around[i + 1] if i + 1 < len(base) else none)) for i, b in enumerate(base)]


#: A content sentence; every labelled row is also learnt among copies of it, before, after and around.
LONG = "설비 노후화가 이어지는 가운데 회사는 새 공장을 지어 생산 능력을 늘렸습니다. "


def train() -> Tree:
    """The tree of the labelled table: every row alone, inside longer blocks where its kind may stand
    there, and next to blocks of every kind and length."""
    rows = [line.split("|", 1) for line in LABELLED.strip().split("\n")]
    # in rendered HTML a link is no markup any more: it makes boilerplate or nothing
    shown = [(label, re.sub(r"<a\b[^>]*>(.*?)</a>", rf"{LINK_ON}\1{LINK_OFF}", text)) for label, text in rows]
    rows += [[label if label == "boilerplate" else "content", text] for label, text in shown if LINK_ON in text]
    x, y = features([r[1] for r in rows]), [r[0] for r in rows]
    beside = ["", LONG, LONG * 4, *(next(t for lab, t in rows if lab == kind) for kind in ("residue", "boilerplate")), "합계", "# 개요"]
    for i, (label, text) in enumerate(rows):
        inline = label != "boilerplate" and text[:1] not in "#=|!{`>" and not text.startswith("- ")
        blocks = [text]
        for copies in (1, 2, 5, 9) if inline else ():
            blocks += [text + " " + LONG * copies, LONG * copies + text, LONG + text + " " + LONG * copies]
        for k, block in enumerate(blocks):
            for before in range(len(beside)):
                x.append(features([beside[before], block, beside[(before + i + k) % len(beside)]])[1])
                y.append(label)
    return Tree(max_depth=10, min_leaf=4).fit(np.array(x), np.array(y))


class _Trained:
    """The tree, trained once when it is first asked for; it travels with the functions that use it."""

    def __init__(self):
        self.tree: Tree | None = None

    def ready(self) -> None:
        self.tree = self.tree or train()

    def label(self, row: tuple) -> str:
        self.ready()
        return self.tree.label(row)


TREE = _Trained()


def labels(lines: list[str]) -> list[str]:
    """content, residue or boilerplate for each block of a value."""
    return [TREE.label(row) for row in features(lines)]


def residue(value: str | None) -> bool:
    """Whether a flat text holds markup: a block of it is no content."""
    return bool(value) and any(label != "content" for label in labels(value.split("\n")))


def found(rows: DataFrame, key: str, column: str, html: bool, field: str) -> DataFrame:
    """(field, rec_id) of records whose ``column`` (text, or an array of HTML values) holds markup."""
    TREE.ready()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                values = v if isinstance(v, list) else [v]
                if k is not None and any(residue(marks.visible(x) if html else x) for x in values if x):
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(keys), pa.string()), pa.array(keys, pa.int64())], ["field", "rec_id"])

    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("rec_id", T.LongType())])
    return rows.where(F.col(column).isNotNull()).select(F.col(key).cast("bigint"), column).mapInArrow(run, schema)


_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(style|script)\b[^>]*>.*?(?:</\1\s*>|$)|</?([A-Za-z][A-Za-z0-9-]*)(?:\s[^<>]*|/)?>", re.S | re.I)


def from_html(source: str) -> str:
    """Clean text of an HTML value: headings as ``# x``, list items as ``- x``, table rows with bars (rows
    of nested tables within their cell, behind semicolons), preformatted text fenced; inline marks leave
    their text. Blocks the tree calls boilerplate are left out, residue in the visible text is rendered."""
    out: list[tuple[str, str, bool]] = []  # prefix, text, whether it is code
    line: list[str] = []
    cells = depth = 0
    pre, prefix, at = False, "", 0

    def flush() -> None:
        text = "".join(line)
        text = text.strip("\n") if pre else re.sub(r"[ \t\r\f\v\xa0]+", " ", text).strip()
        if text.strip(f" |{LINK_ON}{LINK_OFF}"):
            out.append((prefix, text, pre))
        line.clear()

    for m in _TOKEN.finditer(source):
        text = marks.unescape_once(source[at : m.start()])
        line.append(text if pre else text.replace("\n", " "))
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[0].startswith("</")
        if tag == "table":
            depth += -1 if closing else 1
            if depth < (0 if closing else 2):
                flush()
                cells = depth = max(depth, 0)
                cells, prefix = 0, ""
            elif closing and depth == 0:
                flush()
                cells = 0
        elif depth > 1 and tag in ("tr", "td", "th"):
            line.append("" if closing else "; " if tag == "tr" else " ")
        elif tag in ("td", "th"):
            if not closing:
                line.append(" | " if cells else "")
                cells += 1
        elif tag == "tr":
            flush()
            cells, prefix = 0, ""
        elif tag == "pre":
            flush()
            pre, prefix = not closing, ""
        elif tag == "a" and not pre:
            line.append(LINK_OFF if closing else LINK_ON)
        elif re.fullmatch("h[1-6]|title", tag):
            flush()
            prefix = "" if closing else "#" * (int(tag[1]) if tag[1].isdigit() else 1) + " "
        elif tag == "li":
            flush()
            prefix = "" if closing else "- "
        elif (tag == "br" or tag in marks._BREAKS or tag.startswith("section")) and not cells:
            flush()
            prefix = prefix if tag == "br" else ""
        elif tag == "br":
            line.append(" ")
    line.append(marks.unescape_once(source[at:]))
    flush()
    told = labels([text for _, text, _ in out])
    lines = []
    for (prefix, text, code), label in zip(out, told):
        text = text.replace(LINK_ON, "").replace(LINK_OFF, "")
        if code:
            lines += ["```", text, "```"]
        elif label != "boilerplate":
            lines.append(prefix + (from_text(text) if label == "residue" else text))
    return "\n".join(lines)


_INLINE = (
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n]*)\]\((?:[^()\s]+)\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n(]+)\]\]"), r"\1"),
    (re.compile(r"\*\*(?=\S)([^*\n]+?)\*\*|__(?=[^\s_])([^_\n]+?)__(?![\w_])|~~(?=\S)([^~\n]+?)~~|\'\'\'?(?=\S)([^\'\n]+?)\'\'\'?"), lambda m: next(g for g in m.groups() if g)),
    (re.compile(r"(?m)^\s*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1\s*$"), lambda m: "#" * len(m[1]) + " " + m[2]),
    (re.compile(r"(?m)^\s*(?:\{\|.*|\|\}|\|-.*|\|?(?:\s*:?-{3,}:?\s*\|)+[-:|\s]*)$\n?"), ""),
    (re.compile(r"(?m)^\s*[|!]\s*(.+?)\s*\|?\s*$"), lambda m: re.sub(r"\s*(?:!!|\|\||\|)\s*", " | ", m[1])),
    (re.compile(r"\\((?:sub){0,2})section\*?\{([^{}]*)\}[ \t]*\n?"), lambda m: "\n" + "#" * (1 + len(m[1]) // 3) + " " + m[2] + "\n"),
    (re.compile(r"\\(?:textbf|textit|texttt|emph|underline|caption|url|footnote|paragraph)\{([^{}]*)\}|\\href\{[^{}]*\}\{([^{}]*)\}"), lambda m: m[1] if m[1] is not None else m[2]),
    (re.compile(r"\\item\s*"), "\n- "),
    (re.compile(r"\\(?:begin|end)\{[a-z]+\*?\}(?:\[[^\]]*\])?|\\(?:cite|label|ref)\{[^{}]*\}"), ""),
    (re.compile(r"\\([%&#_])"), r"\1"),
)
_CODE = re.compile(r"```.*?```|~~~.*?~~~", re.S)
_VERBATIM = re.compile(r"[ \t]*\\begin\{(verbatim|lstlisting)\}(?:\[[^\]\n]*\])?\n?(.*?)\n?[ \t]*\\end\{\1\}", re.S)
_EQUATION = re.compile(r"[ \t]*\\begin\{(equation|align|gather|multline|displaymath|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
_TABULAR = re.compile(r"[ \t]*\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", re.S)
_FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$\s\d][^$\n]*\$|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
_HELD = re.compile("\x00(\\d+)\x00")


def from_text(value: str) -> str:
    """Clean text of a flat value. Code (fenced), displayed and inline formulas and form placeholders are
    kept as they stand; of the other blocks, the tree's residue is rendered (headings as ``# x``, items
    as ``- x``, table rows with bars, inline marks leave their text), boilerplate is left out and
    content is not touched."""
    held: list[str] = []

    def hold(text: str) -> str:
        held.append(text)
        return f"\x00{len(held) - 1}\x00"

    t = _CODE.sub(lambda m: hold(m[0]), value.replace("\x00", ""))
    t = _VERBATIM.sub(lambda m: hold(f"```\n{m[2]}\n```"), t)
    t = _EQUATION.sub(lambda m: hold(f"$${m[3].strip()}$$"), t)
    t = _TABULAR.sub(lambda m: hold("\n".join(re.sub(r"\s*(?<!\\)&\s*", " | ", row).strip() for row in re.split(r"\\\\|\\hline", m[1]) if row.strip())), t)
    lines = t.split("\n")
    told = labels(lines)
    out: list[str] = []
    for wanted, run in itertools.groupby(zip(told, lines), key=lambda x: x[0]):
        if wanted == "content":
            out += [line for _, line in run]
        elif wanted == "residue":
            out.append(_rendered("\n".join(line for _, line in run), hold))
    t = "\n".join(out)
    while _HELD.search(t):
        t = _HELD.sub(lambda m: held[int(m[1])], t)
    return t


def _rendered(t: str, hold) -> str:
    t = _FORMULA.sub(lambda m: hold(m[0]), t)
    t = marks.FORM.sub(lambda m: hold(m[0]), t)
    t = re.sub(r"`([^`\n]+)`", r"\1", t)
    for pattern, to in _INLINE:
        t = pattern.sub(to, t)
    t = re.sub(r"\n{2,}", "\n", t).strip("\n")
    if marks.TAG.search(t):
        return "\n".join(_untagged(x) if marks.TAG.search(x) else marks.unescape_once(x) for x in t.split("\n"))
    return marks.ENTITY.sub(lambda m: "\n" if m[0].startswith("&cr") else marks.html.unescape(m[0]), t) if "&" in t else t


def _untagged(line: str) -> str:
    """A line of a flat text without its tags: line breaks at blocks, bars between cells."""
    cell = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^<>]*>", " | ", line, flags=re.I)
    return re.sub(r"\n{2,}", "\n", marks.visible(cell)).strip("\n")


def clean(rows: DataFrame, key: str, column: str, html: bool, field: str) -> DataFrame:
    """(field, rec_id, part, clean_text): one row per value, ``part`` counting an array's values from 1.

    Null values give null, empty ones empty text; of rows with one key the greatest value counts, and
    rows without a key are left out.
    """
    TREE.ready()
    render = from_html if html else from_text

    @arrow(T.StringType())
    def cleaned(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else render(v) for v in values.to_pylist()], pa.string())

    keyed = rows.select(F.col(key).cast("bigint").alias("rec_id"), F.col(column).alias("_v"))
    # repeated rows meet before their texts are rendered
    one = keyed.where("rec_id is not null").groupBy("rec_id").agg(F.max("_v").alias("_v"))
    if dict(rows.dtypes)[column].startswith("array"):
        parts = one.select("rec_id", F.posexplode("_v").alias("_p", "_v")).withColumn("part", F.col("_p") + 1)
    else:
        parts = one.withColumn("part", F.lit(1))
    return parts.select(F.lit(field).alias("field"), "rec_id", "part", cleaned("_v").alias("clean_text"))
