"""Trusted labels of template residue: a small table of hand-checked sentences, and patterns for what is
written in the syntax of templates, logs and protocols. Altered forms are left to the near-duplicates."""

from __future__ import annotations

import re

#: Unfilled placeholders and form instructions.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]*\}|<%=?[^%\n]*%>|@@[A-Z0-9_.]+@@|\[\[[^\[\]\n]*(?:기재|입력|작성)[^\[\]\n]*\]\]|#[가-힣]{2,10}#|%[가-힣]{2,10}%|\{[가-힣]{2,10}\}|\{[a-z_]+(?:\.[a-z_]+)*\}"
    r"|(?:은\(는\)|을\(를\)|이\(가\)|와\(과\))|_{3,}|(?<![^\s(\"'])[○◯]{2,}(?=[가-힣]{0,8}(?:[\s(),.]|$))|(?<!\S)□{3,}(?=[가-힣]{0,8}(?:[\s(),.]|$))|\d\dXX년|X{1,2}월 X{1,2}일|◆\s*click\s*◆|◆클릭◆|#\*_\S*\.dsl|\.dsl\b|^\s*\(?\s*작성\s*요령\s*[:：]|^\s*(?:TODO|TBD|FIXME)\b\s*[:：]"
    r"|\((?:금액|내용|날짜|회사명|이름) (?:기재|입력)\)|이곳에 .{0,40} (?:적고|적으|기재|입력)|여기에 (?:기재|입력)|(?:을|를) (?:입력|기재)(?:하십시오|하세요|하여 주(?:시기|십시오)|해 주(?:세요|십시오))|\[(?:insert|enter|your) [^\]]*\]",
    re.I,
)
#: Filler text.
FILLER = re.compile(r"^\W*lorem ipsum\b|\b(?:asdf|qwer|qwerty)\b(?:\s+\w+){0,2}\s+(?:asdf|qwer)\b|\bx{3,}\s+x{3,}\s+x{3,}|가나다라 ?마바사|테스트 ?(?:문장|텍스트|문구)(?:입니다)? 테스트|(?:샘플 텍스트 ?){2,}|(?:내용){3,}|본문이 들어갈 자리|(?:더미|샘플) (?:텍스트|문장)입니다|\bdolor sit amet\b", re.I)
#: Status lines, traces and codes, and the families of notices that name what could not be shown.
MESSAGE = re.compile(
    r"^\W*\d{3} (?:Not Found|Forbidden|Unauthorized|Bad Request|Bad Gateway|Gateway Time-?out|Internal Server Error|Service (?:Temporarily )?Unavailable|Method Not Allowed|Gone)\W*$"
    r"|^\W*(?:sorry, )?the (?:page|file|filing|document|attachment|section) you (?:requested|are looking for) (?:could not|cannot|was not)|^\W*sorry, the \w+ you requested"
    r"|^\W*please (?:enable|turn on|allow|activate) (?:cookies|scripts?|javascript|popups?)|^\W*(?:this (?:page|site) requires|you need to enable) (?:javascript|cookies)|^\W*loading[.,… ]|please wait\W*$"
    r"|^\W*(?:[a-z]+\.)+[A-Z]\w*(?:Exception|Error)\b|^\W*ORA-\d{5}:|^\W*Traceback \(most recent|^\W*(?:Fatal|Parse|Uncaught \w*) ?Error\b"
    r"|일시적인 오류로 .{0,20}(?:불러오지|표시하지|처리하지) 못했습니다|오류코드 [A-Z]{2}-\d+|요청하신 .{1,30}[을를] 찾을 수 없습니다|(?:열람 )?서비스(?:가|를) 중단(?:됩니다|합니다)|로딩 중입니다",
    re.I,
)
#: Statements about such things, which are content: quotations.
ABOUT = re.compile(r"라는 (?:안내|문구|표시|화면)")
#: The labelled table: kind, a bar, the sentence. Content rows keep look-alikes from taking a label.
LABELLED = """
message|관리자에게 문의하세요.
message|관리자에게 문의하시기 바랍니다.
message|다시 로그인해 주십시오.
message|데이터를 불러오고 있습니다
message|동시 접속자가 많아 요청을 처리할 수 없습니다.
message|이용자가 많아 접속이 지연되고 있습니다.
message|뷰어 플러그인이 설치되지 않았습니다.
message|브라우저의 스크립트 기능이 꺼져 있어 표를 표시할 수 없습니다.
message|브라우저에서 자바스크립트를 허용해 주십시오.
message|브라우저에서 쿠키를 허용해 주십시오.
message|비정상적인 접근이 감지되어 연결을 차단하였습니다.
message|설치 후 다시 열어 주십시오.
message|설치 후 새로 고침해 주십시오.
message|세션이 만료되었습니다.
message|이 문서를 보려면 자바스크립트를 사용하도록 설정해야 합니다.
message|이 페이지를 보려면 자바스크립트를 사용하도록 설정해야 합니다.
message|잠시 후 다시 시도해 주세요.
message|잠시 후 다시 접속해 주세요.
message|잠시만 기다려 주십시오
message|접근 권한이 없습니다.
message|주소를 다시 확인하시기 바랍니다.
message|주소를 다시 확인해 주세요.
message|쿠키가 차단되어 있습니다.
message|허용한 뒤 새로 고침하십시오.
message|This site uses cookies to improve your experience.
message|An unexpected error occurred while processing your request.
message|Your session has expired. Please log in again.
filler|임시 문구이므로 무시하십시오.
filler|이 문장은 견본이므로 지우고 쓰십시오.
filler|This is placeholder text and should be replaced.
content|회사는 접근 권한이 없는 사람의 출입을 막고 있습니다.
content|회사는 세션이 만료되면 다시 로그인하도록 시스템을 고쳤습니다.
content|쿠키를 만드는 공장은 두 곳입니다.
content|잠시 멈춘 설비는 다시 돌고 있습니다.
"""
TABLE = {sentence: kind for kind, _, sentence in (line.partition("|") for line in LABELLED.strip().split("\n"))}


# Literal parts, one of which every rule above needs: sentences without any are not searched further.
HINTS = (
    "{{ ${ <% @@ [[ # % { (는) (를) (가) (과) ___ ○○ ◯◯ □□ XX년 X월 ◆ .dsl 작성 TODO TBD FIXME 기재) 입력 이곳에 여기에 기재하 기재해 [insert [enter [your lorem asdf qwer xxx 가나다라 테스트 샘플 더미 내용내용 들어갈 "
    "dolor not bad gateway forbidden unauthorized internal service method gone sorry the please requires need loading exception error ora- traceback 오류 요청하신 중단 로딩"
).split()


def _automaton():
    try:
        import ahocorasick
    except ImportError:
        return None
    a = ahocorasick.Automaton()
    for h in HINTS:
        a.add_word(h.lower(), True)
    a.make_automaton()
    return a


def kinds(sentences: list[str]) -> list[str | None]:
    """``kind`` of many sentences."""
    a = _automaton()
    if a is None:
        return [kind(s) for s in sentences]
    return [TABLE.get(s) or (kind(s) if next(a.iter(s.lower()), None) else None) for s in sentences]


def kind(sentence: str) -> str | None:
    """placeholder, filler, message, content and about (trusted content that mentions residue), or None."""
    if sentence in TABLE:
        return TABLE[sentence]
    if PLACEHOLDER.search(sentence):
        return "placeholder"
    if FILLER.search(sentence):
        return "filler"
    if MESSAGE.search(sentence):
        return "about" if ABOUT.search(sentence) else "message"
    return None


SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
