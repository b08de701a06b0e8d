"""Similarities, diffs, near-duplicate paragraphs, contamination and name matching."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from filamento.operators import similarity as M


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items())).select(expr).first()[0]


def test_scalar_similarities(spark):
    base, near, far = "회사는 제품을 만들고 팝니다", "회사는 제품을 만들어 팝니다", "환율은 크게 올랐습니다"
    for f in (lambda: M.levenshtein_similarity(F.col("a"), F.col("b")), lambda: M.difflib_ratio("a", "b"), lambda: M.gram_jaccard("a", "b")):
        assert one(spark, f(), a=base, b=near) > one(spark, f(), a=base, b=far)
        assert one(spark, f(), a=base, b=base) == pytest.approx(1.0)
    assert one(spark, M.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, M.difflib_ratio("a", "b"), a="x" * 20001, b="x") is None


def test_diff(spark):
    d = one(spark, M.paragraph_diff("a", "b"), a=["A", "B", "C"], b=["A", "B2", "C", "D"])
    assert (d.added, d.modified, d.removed, d.n_same) == (["D"], ["B2"], ["B"], 2)
    assert one(spark, M.paragraph_diff("a", "b"), a=[], b=["x"]).added == ["x"]


def jac(a, b):
    g = lambda t: {t.replace(" ", "")[i : i + 3] for i in range(max(1, len(t.replace(" ", "")) - 2))}
    return len(g(a) & g(b)) / len(g(a) | g(b))


def test_near_texts_against_brute_force(spark):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("가나다라마바사아자차") for _ in range(40)) for _ in range(12)]
    texts = base + [t[:k] + "하" + t[k:] for t in base for k in (3, 20)] + [base[0], None, "", "가"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.a, r.b) for r in M.near_texts(df, "t", 0.8).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations({t for t in texts if t}, 2) if jac(a, b) >= 0.8}
    assert got == want and want


def test_common_paragraphs_skip_the_same_group(spark):
    p = "본 문단은 모든 회사가 같은 서식으로 적는 문단이며 내용이 같습니다"
    rows = [("A", 1, p), ("B", 1, p), ("C", 1, p + "."), ("A", 1, p + "!"), ("D", 2, p), ("E", 1, "전혀 다른 내용의 문단이 여기에 적혀 있으며 길이도 다릅니다")]
    df = spark.createDataFrame(rows, "e string, s int, p string")
    pairs = {(r.a_entity, r.b_entity) for r in M.common_paragraphs(df, entity="e", scope=["s"], text="p").collect()}
    assert pairs == {("A", "B"), ("A", "C"), ("B", "C")}
    out = spark.createDataFrame([("A", "B")], "a string, b string")
    kept = M.common_paragraphs(df, entity="e", scope=["s"], text="p", exclude=out)
    assert {(r.a_entity, r.b_entity) for r in kept.collect()} == {("A", "C"), ("B", "C")}
    assert {(r.entity, r.n_partners) for r in M.partner_counts(kept, ["s"]).where("entity = 'C'").collect()} == {("C", 2)}


def test_contamination_counts_characters(spark):
    rows = [(1, "리스부채" + "x" * 2)] + [(1, "y" * 594)] + [(2, "")]
    df = spark.createDataFrame(rows, "d int, p string")
    got = {r.d: r for r in M.contamination(df, ["d"], "p", ["리스부채", "손상차손"]).collect()}
    assert got[1].share_chars == 0.01 and got[1].share_paras == 0.5 and got[1].markers_found == "리스부채"
    assert got[2].share_chars == 0.0


def test_tfidf(spark):
    df = spark.createDataFrame([("A", "s", 1, "가나 다라"), ("A", "s", 2, "가나 다라"), ("A", "s", 4, "마바사"), ("B", "s", 1, "가나"), ("B", "s", 2, None)], "e string, sec string, y int, t string")
    got = {(r.e, r.prev, r.cur): r.cosine for r in M.tfidf_cosine(df, entity="e", section="sec", period="y", text="t").collect()}
    assert got["A", 1, 2] == pytest.approx(1.0) and got["A", 2, 4] == 0.0 and got["B", 1, 2] == 0.0
    rates = {(r.e, r.cur): r for r in M.change_rates(df, entity="e", section="sec", period="y", text="t").collect()}
    assert rates["A", 2].change_levenshtein == 0.0 and rates["A", 4].change_jaccard == 1.0


def test_name_matching(spark):
    names = spark.createDataFrame([(1, "주식회사 에코프로비엠"), (2, "에코프로비엠홀딩스그룹사"), (3, "다른이름"), (4, None)], "k int, n string")
    choices = spark.createDataFrame([("에코프로비엠(주)",), ("에코프로비엠홀딩스그룹",), (None,)], "c string")
    got = {r.k: (r.choice, r.match_type) for r in M.match_names(names, choices, key="k", name="n", choice="c").collect()}
    assert got == {1: ("에코프로비엠(주)", "exact"), 2: ("에코프로비엠홀딩스그룹", "fuzzy")}


def test_text_classes_against_all_pairs(spark):
    rnd = random.Random(11)
    bases = ["회사는 새로운 공장을 지어서 생산 능력을 크게 늘렸으며 내년에도 늘릴 계획입니다", "제 12 조에 따라 이사회는 배당을 결의하였고 주주총회의 승인을 받을 예정입니다", "환율이 크게 올라 수입 원료의 값이 뛰었고 그 영향은 다음 해까지 이어질 것입니다"]
    texts = [b + tail for b in bases for tail in ("", " 네", " 예", "!")]
    rows = [(rnd.choice("xy"), f"f{rnd.randrange(9)}", rnd.choice(texts)) for _ in range(160)] + [("x", None, texts[0]), ("x", "f1", None)]
    c = M.TextClasses(spark.createDataFrame(rows, "s string, e string, t string"), entity="e", scope=["s"], text="t")
    held = collections.Counter(r for r in rows if None not in r)
    sim = {(a, b): M.M.jaccard(M.M.grams(a), M.M.grams(b)) for a in texts for b in texts}
    pairs = [(s, e, f, t, u) for (s, e, t) in held for (r, f, u) in held if s == r and e < f and sim[t, u] >= 0.8]
    count = lambda rows: dict(collections.Counter(rows))
    got = c.pairs().collect()
    n, raw = collections.Counter(), collections.Counter()
    for s, e, f, t, u in pairs:
        n[s, *sorted((t, u))] += 1
        raw[s, *sorted((t, u))] += held[s, e, t] * held[s, f, u]
    assert {(r.s, *sorted((r.a, r.b))): (r.n_pairs, r.n_raw) for r in got} == {k: (n[k], raw[k]) for k in n} and len(n) > 20
    assert {(r.s, r.entity): r.n_appearances for r in c.appearances().collect()} == count((s, x) for s, e, f, *_ in pairs for x in (e, f))
    partners = {}
    for s, e, f, t, u in pairs:
        partners.setdefault((s, e, t), set()).add(f)
        partners.setdefault((s, f, u), set()).add(e)
    assert {(r.s, r.entity, r.text): r.n_partners for r in c.partners().collect()} == {k: len(v) for k, v in partners.items()}
    label = {t: t[-1] for t in texts}
    assert {(r.s, r.label): r.n for r in c.labelled(F.right("text", F.lit(1))).collect()} == count((s, label[t]) for s, e, f, t, u in pairs)
    top = {(r.s, r.a_entity, r.b_entity, r.a, r.b) for r in c.top(7).collect()}
    want = {x for scope in "xy" for x in sorted((p for p in pairs if p[0] == scope), key=lambda p: (-sim[p[3], p[4]], *sorted(p[3:]), p[1], p[2], p[3]))[:7]}
    assert top == want
    assert c.top(10**6).count() == len(pairs)
    none = M.TextClasses(spark.createDataFrame([], "s string, e string, t string"), entity="e", scope=["s"], text="t")
    assert none.pairs().isEmpty() and none.partners().isEmpty() and none.appearances().isEmpty() and none.top(3).isEmpty()


def test_cosine_of_arrays_equals_the_joined_one(spark):
    rnd = random.Random(13)
    rows = [(e, s, y, " ".join(rnd.choice(["공장", "매출 증가", "재고", "Plant", "ＡＢ"]) for _ in range(rnd.randint(0, 9)))) for e in "AB" for s in "xy" for y in (2015, 2016, 2018)] + [("C", "x", 2015, None), ("C", "x", 2016, "가")]
    df = spark.createDataFrame(rows, "e string, s string, y int, t string")
    opts = {"entity": "e", "section": "s", "period": "y", "text": "t"}
    got, joined = ({(r.e, r.s, r.prev, r.cur): r.cosine for r in M.tfidf_cosine(df, **opts, **more).collect()} for more in ({}, {"idf_rows": 1}))
    assert got.keys() == joined.keys() and all(got[k] == pytest.approx(joined[k]) for k in got) and len(got) == 9
    assert M.tfidf_cosine(df.limit(0), **opts).isEmpty()
