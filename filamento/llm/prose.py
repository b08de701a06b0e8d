"""Text quality statistics that tell prose from lists, tables, word strings and junk.

Every entry becomes a distribution over function-word and character classes. Jensen-Shannon
divergence to profiles (prose of two languages, and structures that are no prose) names the nearest
one. The profiles are estimated from a small table of labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of words; a word's length in characters is its weight.
CLASSES = ("final", "function", "noun", "latin", "latin_function", "number", "mark", "leader", "code", "junk", "repeat")
# Sentence-final endings, particles and connective endings of Korean; function words of English.
_WORD = re.compile(
    r"(?P<leader>\.{4,}|…{2,}|·{4,}|-{4,}|_{4,})"
    r"|(?P<final>[가-힣A-Za-z0-9.,%()'\"’”」』]{0,40}(?:다|까|요|오|함|음|됨|임|없음|있음)[.?!。]+[)\"'”’」』]*|[A-Za-z][A-Za-z'’-]*[.?!]+(?=\s|$))"
    r"|(?P<latin_function>\b(?:the|a|an|of|and|or|in|on|at|to|for|from|by|with|is|are|was|were|be|been|has|have|had|that|this|which|who|its|it|as|not|but|than|their|our|we|they|will|may|when|while|because|before|after|against|under|into|more|some|too)\b)"
    r"|(?P<function>[가-힣A-Za-z0-9.,%()'\"“”‘’『』「」·&/-]{0,40}[가-힣)%\"'”’』」](?:은|는|이|가|을|를|에|의|로|와|과|도|만|며|고|서|여|어|아|해|한|할|된|될|인|던|면|지|게|자|까지|부터|에서|에게|으로|마다|보다|처럼|라는|다는|하여|되어|있는|없는|하는|되는|따라|대한|위한|관한|통한|함께|다만|한편|또한|이후|별개로|이와)(?=[\s,;:]|$)[,;:]?)"
    r"|(?P<code>(?=[A-Za-z0-9-]*\d)(?=[A-Za-z0-9-]*[A-Za-z])[A-Za-z0-9]{2,}(?:-[A-Za-z0-9]+)*|\d+(?:-\d+){2,})"
    r"|(?P<number>[△▲▽▼+\-−(]?\d[\d,.:/~-]*\)?%?(?:개|명|원|건|년|월|일|회|백만원|천원|천톤)?)"
    r"|(?P<noun>[가-힣]+)|(?P<latin>[A-Za-z][A-Za-z'’-]*)"
    r"|(?P<mark>[-–—•·ㅇᄋ○●◦▪■□▶▷◆◇※*+/|:;,.()\[\]{}<>&%$#@!?\"'“”‘’「」『』~^=`_\\]+)"
    r"|(?P<junk>\S)"
)
# The labelled texts, invented: kind, a bar, a text. A profile is the mean distribution of its kind's texts.
LABELLED = """
prose_ko|회사는 새 공장을 지어 생산 능력을 늘렸습니다.
prose_ko|당기 매출은 1,204억원으로 전기보다 8.3% 늘었으며, 이는 수출 단가가 오른 데 따른 것입니다.
prose_ko|이사회는 3월 21일에 배당을 결의하였습니다. 배당금은 주당 500원이며 4월에 지급할 예정입니다.
prose_ko|연구소는 소재를 가볍게 하는 방법을 찾고 있으며 시제품은 내년 상반기에 고객에게 보낼 계획입니다. 다만 인증 절차가 늦어질 수 있습니다.
prose_ko|원재료 가격과 환율이 함께 올라 제조원가가 늘었으나 회사는 장기 계약을 맺어 부담을 줄였습니다.
prose_ko|소송은 현재 1심이 진행 중이며 결과를 예측할 수 없습니다. 회사는 변호인의 의견을 들어 충당부채를 쌓지 않았습니다.
prose_ko|해외 법인은 세 나라에 있고, 그 가운데 두 곳은 2019년에 세워졌습니다. 현지 직원은 140명이며 관리자는 본사에서 보냅니다.
prose_ko|판매는 대리점을 통하여 이루어지며 대금은 60일 안에 받습니다.
prose_ko|안전 점검 결과 설비 2대를 바꾸었고, 관련 비용 37백만원은 수선비로 처리하였습니다.
prose_en|The company sold more noodles this year because many schools came to the shop.
prose_en|Revenue rose by 8.3% to 1,204 million won, and the board expects that demand will stay firm in the next year.
prose_en|It is not clear when the court will decide. We have not recorded a provision for this case.
prose_en|Our plants were closed for two weeks while the lines were being rebuilt.
list|- 구리 박판
list|- 매출채권 12,000원
list|ㅇ 생산 능력 확대
list|▶ 신규 거래처 : 3개사
list|○ 품질 인증 취득
list|* 산화철
list|- 해외 법인 설립 2건
list|· 재고자산
table|매출액 1,234 2,345 △345 5.1%
table|구리 1,204,333 20,113 87.2%
table|서울공장 45,120 39,402 -5,718 12.7%
table|당기 3,400 전기 2,900
table|합계 9,120,443 8,003,110 14.0%
table|1,234
contents|1. 사업의 개요 ................ 12
contents|3. 주요 제품 .................. 18
contents|II. 재무에 관한 사항 ............................ 104
contents|12. 연구개발 활동 ····················· 77
words|구리 알루미나 재고자산 차입금 매출채권 붕산 황산
words|생산본부 품질보증실 영업팀 인사팀 재무팀 연구소 물류센터
words|매출총이익
words|목재 칩 식용유 포장재 병뚜껑 유리병 종이상자 접착제
words_en|copper tin zinc lead nickel cobalt silver
words_en|Revenue Margin Assets Liabilities Equity
contact|Tel 02-2960-7995 / 담당 가나다 / Pine65
contact|Fax 51-0339-1120 / 라마바 / Oak12
contact|Rev 20-1065-4369 / AB-1200-77 / Elm30
contact|문의 031-555-0142-77 / 사아자 / K3200
repetition|구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울 구리 박판 서울
repetition|합계 합계 합계 합계 합계 합계 합계 합계 합계 합계 합계 합계 합계 합계 합계
junk|가◎»¤°▲※°◇나◇¶다□¶‡●라◆부×¡너°¶÷°◆×별▽※°
junk|ª© ªª ñì¨ê¦±ð¤¤ ð¦«í¥Ÿ
junk|담★◇«○«°◆치치×▽람조★▽¦○¬¶§
"""
PROSE = ("prose_ko", "prose_en")
_INDEX = {c: i for i, c in enumerate(CLASSES)}
REPEAT = _INDEX["repeat"]


def weights(text: str) -> list[float]:
    """Characters of a text by class; words beyond the second use of a word pair count as repeats."""
    w = [0.0] * len(CLASSES)
    seen: dict[tuple, int] = {}
    last = ""
    for m in _WORD.finditer(text):
        word = m[0]
        pair = (last, word)
        n = seen[pair] = seen.get(pair, 0) + 1
        last = word
        w[REPEAT if n > 2 and len(word) > 1 else _INDEX[m.lastgroup]] += len(word)
    return w


def _estimated() -> tuple[list[str], np.ndarray]:
    """Names of the profiles, and the mean share of characters by class over the texts of each kind."""
    shares: dict[str, list[np.ndarray]] = {}
    for kind, _, text in (line.partition("|") for line in LABELLED.strip().split("\n")):
        w = np.array(weights(text))
        shares.setdefault(kind, []).append(w / w.sum())
    p = np.array([np.mean(v, 0) for v in shares.values()]) + 1e-6
    return list(shares), p / p.sum(1, keepdims=True)


NAMES, _P = _estimated()


def divergence(rows: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row's distribution from every profile."""
    p = rows + 1e-6
    p = p / p.sum(1, keepdims=True)
    m = (p[:, None, :] + _P[None]) / 2
    kl = lambda a, b: (a * np.log2(a / b)).sum(-1)
    return (kl(p[:, None, :], m) + kl(np.broadcast_to(_P[None], m.shape), m)) / 2


def assign(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest profile (-1 without visible characters) and its divergence, by row of weights."""
    d = divergence(w)
    best = d.argmin(1)
    return np.where(w.sum(1) > 0, best, -1), d[np.arange(len(w)), best]


def nearest(texts: list[str]) -> list[str]:
    """The profile of each text; a text without visible characters has the profile empty."""
    return [NAMES[i] if i >= 0 else "empty" for i in assign(np.array([weights(t) for t in texts]).reshape(-1, len(CLASSES)))[0]]


STATS = T.StructType(
    [
        T.StructField("n_paragraphs", T.IntegerType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_under_10", T.IntegerType()),
        T.StructField("mean_chars", T.DoubleType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("mean_word_chars", T.DoubleType()),
        T.StructField("symbol_ratio", T.DoubleType()),
        T.StructField("end_punctuation_share", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        T.StructField("divergence", T.DoubleType()),
        T.StructField("prose_chars", T.LongType()),
        T.StructField("profile", T.StringType()),
    ]
)
_END = re.compile(r"[.?!。][)\"'”’」』]*$")
_SYMBOL = re.compile(r"[^\w\s]")


def statistics(documents: list[list[str | None] | None]) -> list[dict | None]:
    """Statistics of each document's entries; null entries don't count, and no entries give null."""
    kept = [[p for p in e or [] if p is not None] for e in documents]
    flat = [weights(t) for texts in kept for t in texts]
    w = np.array(flat).reshape(-1, len(CLASSES))
    index, div = assign(w) if len(w) else (np.zeros(0, int), np.zeros(0))
    out, at = [], 0
    for texts in kept:
        span = slice(at, at + len(texts))
        at += len(texts)
        if not texts:
            out.append(None)
            continue
        lengths = np.array([len(t) for t in texts])
        total = int(lengths.sum())
        by = np.bincount(index[span] + 1, lengths, len(NAMES) + 1)
        words = [word for t in texts for word in t.split()]
        spread = w[span].sum(0)
        out.append(
            {
                "n_paragraphs": len(texts),
                "n_chars": total,
                "n_under_10": int((lengths < 10).sum()),
                "mean_chars": total / len(texts),
                "n_words": len(words),
                "mean_word_chars": sum(map(len, words)) / len(words) if words else None,
                "symbol_ratio": len(_SYMBOL.findall(" ".join(texts))) / total if total else None,
                "end_punctuation_share": sum(bool(_END.search(t[-8:].rstrip())) for t in texts) / len(texts),
                "common_word_share": float((spread[0] + spread[1] + spread[4]) / spread.sum()) if spread.sum() else None,
                "divergence": float((div[span] * lengths).sum() / total) if total else None,
                "prose_chars": int(by[1] + by[2]),
                "profile": ["empty", *NAMES][int(by.argmax())],
            }
        )
    return out


def quality(rows: DataFrame, key: str, entries: str) -> DataFrame:
    """(key, statistics...) of every row; equal rows stay equal rows, so callers may deduplicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in STATS]
        for b in batches:
            stats = [x or dict.fromkeys(names) for x in statistics(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[n] for s in stats], t) for n, t in zip(names, TYPES))], [key, *names])

    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), entries).mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), *STATS]))


TYPES = [{T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}[f.dataType] for f in STATS]


def not_prose(rows: DataFrame, key: str, entries: str) -> DataFrame:
    """(key, profile, prose_chars, n_chars): documents less than half of whose characters are prose."""
    return quality(rows, key, entries).where("n_chars > 0 and prose_chars * 2 < n_chars").select(key, "profile", "prose_chars", "n_chars")
