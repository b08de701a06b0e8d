"""Residue, prose statistics, near-duplicate sets, packing, leaks and reading levels."""

import collections
import itertools
import random
import time

import numpy as np
import pytest

pytest.importorskip("filamento.llm")

from filamento.llm import leakage, level, nearsets, packing, prose, residue, rules  # noqa: E402

SECTION = "k bigint, p array<string>, t string, kind string"


def sections(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SECTION)


RESIDUE = ["세부 금액은 {설립일} 참조.", "TODO: 재무팀 확인 후 매출액 채워 넣기", "404 Not Found", "Lorem ipsum dolor sit amet", "xxxx xxx xxxx xxx xxxx xxx", "{{corp_name}}의 매출입니다.", "[감사인]은(는) 회사입니다.", "Please enable JavaScript in your browser to continue.", "로딩 중입니다... 잠시만 기다려 주십시오", "○○○ 주식회사는 20XX년 X월 X일 정하였습니다.", "◆click◆『증설』 삽입", "java.lang.NullPointerException at AbViewer.c(3)", "당사는 ____년 __월 __일 설립되었습니다."]
CONTENT = ["해당사항 없음", "빛☆윤☆°○○¬¿바¶◎□□□▽‡가", "'404 Not Found' 화면이 뜨던 주소 3건을 바로잡았습니다.", "접근 권한 관리 체계를 고쳐 승인 절차를 나누었습니다.", "2018년 Lorem-38 글꼴 사용권을 샀습니다.", "{주석 3} 참조 표시는 없습니다.", "고객이 페이지를 찾을 수 없다는 문의는 3건 줄었습니다.", "아래 빈칸 ( )은 확인란입니다.", "서식 작성 요령 교육을 3차례 실시하였습니다.", "'JavaScript를 켜 주세요'라는 안내를 없앴습니다.", "[단위 : 백만원] 매출 3"]


def test_rules():
    bad = ("placeholder", "filler", "message")
    for text in RESIDUE:
        assert any(k in bad for k in rules.kinds(rules.SENTENCE.split(text))), text
    for text in CONTENT:
        assert not any(k in bad for k in rules.kinds(rules.SENTENCE.split(text))), text
    texts = RESIDUE + CONTENT
    assert rules.kinds(texts) == [rules.kind(t) for t in texts]


def test_residue(spark):
    rows = [(1, ["본문입니다.", None, "", "본문입니다. " + RESIDUE[0]], None), (1, ["본문입니다.", None, "", "본문입니다. " + RESIDUE[0]], None), (2, None, RESIDUE[1]), (3, [], "본문입니다."), (4, CONTENT, RESIDUE[0]), (5, None, None), (None, [RESIDUE[0]], None), (6, ["가" * 100000], "")]
    df = sections(spark, rows)
    assert {(r.k, r.para_no) for r in residue.found(df, "k", "p", "t").collect()} == {(1, 4), (2, 0)}
    kept = {r.k: (r.p, r.t) for r in residue.cleaned(df, "k", "p", "t").collect()}
    assert kept[1] == (["본문입니다.", None, ""], None) and kept[4] == (CONTENT, RESIDUE[0]) and 2 not in kept
    assert kept[3] == ([], "본문입니다.") and kept[5] == (None, None)
    more = [(1, [RESIDUE[0], None], f"{RESIDUE[0]}\n"), (2, [RESIDUE[0], "본문입니다."], f" {RESIDUE[0]}\n본문입니다."), (3, None, "본문입니다.")]
    assert {r.k: (r.p, r.t) for r in residue.cleaned(sections(spark, more), "k", "p", "t").collect()} == {2: (["본문입니다."], "본문입니다."), 3: (None, "본문입니다.")}
    assert residue.found(df.limit(0), "k", "p", "t").isEmpty()


def units(spark, rows):
    hashes = residue.simhash([t for _, t, _ in rows])
    return spark.createDataFrame([(*r, int(a), int(b)) for r, (a, b) in zip(rows, hashes)], "uid bigint, unit string, kind string, h0 bigint, h1 bigint")


def test_labels_spread_through_a_component(spark):
    base = "이 문서는 관리자가 아직 올리지 않았으니 담당 부서로 연락한 뒤에 다시 열람하여 주시기를 부탁드립니다 감사합니다"
    chain = [base, base + " 네", base + " 네네", "전혀 다른 본문 문장이 여기에 있습니다"]
    got = {r.uid for r in residue.residue_units(units(spark, [(i, t, "message" if i == 0 else None) for i, t in enumerate(chain)])).collect()}
    near = lambda a, b: residue.similarity(chain[a], chain[b]) >= residue.SIMILAR
    want, grew = {0}, True
    while grew:
        more = {b for a in want for b in range(4) if near(a, b)} - want
        grew, want = bool(more), want | more
    assert got == want and 3 not in got and len(got) > 1


def test_labels_reach_near_units(spark):
    rnd = random.Random(26)
    say = lambda n: "".join(rnd.choice("가나다라마바사아자차카타파하거너더러머버 0") for _ in range(n))
    texts = ["가", "가나", "가나다"]
    for n in (15, 20, 30, 45, 60, 90, 120):
        for _ in range(6):
            base = say(n)
            texts.append(base)
            for edits in (1, 1, 2, 3, 4):
                t = list(base)
                for _ in range(edits):
                    t[rnd.choice([0, -1, rnd.randrange(n)])] = say(1)
                texts.append("".join(t))
    texts = sorted(set(texts))
    rows = [(i, t, "message" if i % 5 == 0 else "content" if i % 17 == 0 else None) for i, t in enumerate(texts)]
    got = {r.uid for r in residue.residue_units(units(spark, rows)).collect()}
    want, frontier = {i for i, _, k in rows if k == "message"}, {i for i, _, k in rows if k == "message"}
    first = len(want)
    while frontier:
        frontier = {i for i, t, k in rows if k is None and i not in want and any(residue.similarity(t, texts[s]) >= residue.SIMILAR for s in frontier)}
        want |= frontier
    assert got <= want and len(got) >= first + 0.9 * (len(want) - first) and len(want) > first + 40


def test_recall_of_the_simhash_tables():
    rnd = random.Random(27)
    say = lambda n: " ".join("".join(rnd.choice("가나다라마바사아자차카타파하고노도로모보소오조초코토포호") for _ in range(rnd.randint(1, 5))) for _ in range(n))
    pairs = []
    while len(pairs) < 3000:
        a = say(rnd.randint(4, 20))
        words = a.split()
        for _ in range(rnd.choice([1, 1, 2, 3])):
            words[rnd.randrange(len(words))] = say(1)
        if residue.SIMILAR <= residue.similarity(a, " ".join(words)) < 1:
            pairs.append((a, " ".join(words)))
    x, y = (residue.simhash([p[i] for p in pairs]) for i in (0, 1))
    meet = (residue.table_keys(x) == residue.table_keys(y)).any(1)
    close = np.array([sum((int(v) & (2**64 - 1)).bit_count() for v in row) for row in x ^ y]) <= residue.HAMMING
    assert (meet & close).mean() >= 0.95


def test_altered_residue_is_found_by_its_neighbours(spark):
    altered = ["브라우저의 스크립트 기능이 꺼져 있어 이 표를 표시할 수 없습니다.", "이 문서를 보려면 먼저 자바스크립트를 사용하도록 설정해야 합니다.", "비정상적인 접근이 감지되어 곧 연결을 차단하였습니다.", "동시 접속자가 많아 지금 요청을 처리할 수 없습니다.", "An unexpected error occurred while processing this request."]
    assert not any(rules.kinds(altered))  # the labels alone find none
    rows = [(i, ["회사는 제품을 팝니다.", t], None) for i, t in enumerate(altered)]
    got = {(r.k, r.para_no) for r in residue.found(sections(spark, rows), "k", "p", "t").collect()}
    want = {(i, 2) for i, t in enumerate(altered) if max(residue.similarity(t, s) for s in rules.TABLE) >= residue.SIMILAR}
    assert got == want and len(want) >= 3


def test_profiles():
    p = prose.nearest
    assert p(["회사는 새 공장을 지어 생산 능력을 늘렸습니다."]) == ["prose_ko"] and p(["The company sold more noodles this year because many schools came to the shop."]) == ["prose_en"]
    assert p(["", "  "]) == ["empty", "empty"]
    for text in ["매출액 1,234 2,345 △345 5.1%", "- 구리 박판 12개", "1. 개요 사업부 ................ 12", "구리 알루미나 재고자산 차입금 매출채권 붕산 황산", "가나 다라 마바 " * 12, "¤ñ¬Ÿ œ±® ®©¥îìž œê¨ï¬ð¨³¤", "Fax 12-3456-7890 / 가나 / Abcd12"]:
        assert p([text])[0] not in prose.PROSE, text
    # a labelled text is nearest to the profile estimated from the others of its kind
    rows = [line.split("|", 1) for line in prose.LABELLED.strip().split("\n")]
    assert sum(p([t])[0] in prose.PROSE for k, t in rows if k in prose.PROSE) == sum(k in prose.PROSE for k, _ in rows)
    assert all(p([t])[0] not in prose.PROSE for k, t in rows if k not in prose.PROSE)
    d = prose.divergence(prose._P)
    assert (d.argmin(1) == np.arange(len(prose.NAMES))).all() and (d >= -1e-9).all() and d.max() <= 1


def test_statistics(spark):
    sentence = "회사는 새 공장을 지어 생산 능력을 늘렸습니다."
    rows = [(1, [sentence, None, "합계"], None), (2, ["합계", "1,234", "- 황산"], None), (3, None, None), (4, [None], None), (5, [""], None), (None, [sentence], None), (6, [sentence * 3000], None)]
    got = {r.k: r for r in prose.quality(sections(spark, rows), "k", "p").collect()}
    assert got[1].n_paragraphs == 2 and got[1].n_under_10 == 1 and got[1].prose_chars == len(sentence) and got[1].end_punctuation_share == 0.5
    assert got[3].n_chars is None and got[4].n_chars is None and got[5].profile == "empty" and got[6].n_chars == len(sentence) * 3000
    assert {r.k for r in prose.not_prose(sections(spark, rows), "k", "p").collect()} == {2, 6}  # one sentence over and over is repetition


def jac(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


@pytest.mark.parametrize("light_size", [None, 0, 10**9, 90])
def test_near_sets_against_brute_force(spark, light_size):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("가나다라마바사아자차카타파하고노도로모보") for _ in range(4))
    rows, key = [], 0
    for size in (30, 60, 120):
        for _ in range(6):
            words = [word() for _ in range(size)]
            for edits in (0, 0, 1, 4):
                w = list(words)
                for _ in range(edits):
                    w[rnd.randrange(size)] = word()
                rows.append((key, [" ".join(w[: size // 2]), None, " ".join(w[size // 2 :])], None))
                key += 1
    rows += [(900, ["짧은 글"], None), (901, None, None), (902, [], None), (None, rows[0][1], None), rows[0]]
    df = sections(spark, rows)
    pairs, members = nearsets.similar_pairs(df, "k", "p", least_chars=100, light_size=light_size)
    got = {(r.k_a, r.k_b) for r in nearsets.expanded(pairs, members, "k").distinct().collect()}
    sets = {k: nearsets.gram_set(p) for k, p, _ in rows if k is not None and k < 900}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jac(sets[a], sets[b]) >= 0.7}
    assert got == want and len(want) > 40
    if light_size is None:
        g = nearsets.groups(pairs, members, "k").collect()
        least = {k: k for k in sets}
        for _ in sets:  # components by repeated relaxation
            for a, b in want:
                least[a] = least[b] = min(least[a], least[b])
        assert {r.k: r.group_id for r in g} == least and len(g) == len(sets)
        assert nearsets.similar_pairs(df.limit(0), "k", "p")[0].isEmpty()


def test_boundary_follows_cost():
    assert nearsets.boundary([(100, 10)], 1.0, 10) == 0  # short lists: scan everything
    assert nearsets.boundary([(100, 100000)], 1e5, 100000) == 100  # crowded lists: enumerate everything
    assert nearsets.boundary([(100, 100000), (5000, 2)], 1e5, 100002) == 100  # a few large sets are scanned


def test_plan_equals_best_fit_on_items():
    rnd = random.Random(8)
    for _ in range(120):
        cap = rnd.randint(3, 50)
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(0, 70))]
        used, n = collections.Counter(), collections.Counter()
        for length, rank, per, first, many, offset in packing.plan(collections.Counter(items), cap):
            n[length] += per * many
            for c in range(first, first + many):
                assert used[c] == offset and offset + per * length <= cap
                used[c] += per * length
        rooms: list[int] = []
        for x in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(cap - x)
        assert n == collections.Counter(items) and len(used) == len(rooms)


def test_packing(spark):
    sizes = {1: 25, 2: 7, 3: 3, 4: 10, 5: 1, 6: 7, 7: 20}
    tokens = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([(1, 10), (1, 10), (2, 100), (3, None), (None, 5), (4, 0)], "spec_id int, capacity_tokens int")
    out = packing.pack(tokens, specs).collect()
    for spec, cap in ((1, 10), (2, 100)):
        mine = [r for r in out if r.spec_id == spec]
        boxes, docs = collections.defaultdict(list), collections.defaultdict(list)
        for r in mine:
            boxes[r.container_id].append((r.at_token, r.n_tokens))
            docs[r.doc_id].append((r.start_token, r.n_tokens))
        for b in boxes.values():
            b.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and sum(b[-1]) <= cap
        for d, parts in docs.items():
            assert sum(n for _, n in parts) == sizes[d] and (len(parts) == 1 or sizes[d] > cap)
    assert {r.spec_id for r in out} == {1, 2}
    assert packing.pack(tokens.limit(0), specs).isEmpty() and packing.pack(tokens, specs.limit(0)).isEmpty()
    docs = spark.createDataFrame([(1, "회사는 제품을 팝니다."), (1, "회사는 제품을 팝니다."), (2, None), (3, ""), (None, "x"), (4, "가나다라 " * 9000)], "doc_id bigint, text string")
    assert {r.doc_id for r in packing.token_counts(docs).collect()} == {1, 4}


ITEMS = "item_id bigint, text string, doc_id string"
DOCS = "doc_id bigint, text string, item_id string"


def test_leaks_against_brute_force(spark):
    rnd = random.Random(1)
    say = lambda n: "".join(rnd.choice("가나다라마바사아자차카타파하 거너더러머버서어저처커터퍼허12345") for _ in range(n))
    items = [(i, say(220)) for i in range(12)] + [(50, None), (51, "짧다"), (None, say(100)), (0, None)]
    docs = []
    for d in range(60):
        body = say(rnd.choice([30, 300, 2000]))
        if d % 3:
            item = items[d % 12][1]
            n = rnd.choice([44, 52, 60, 90, 200])
            s = rnd.randrange(len(item) - n + 1)
            piece = item[s : s + n].upper().replace(" ", " - ")
            body = body[: len(body) // 2] + piece + body[len(body) // 2 :]
        docs.append((d, body, "x"))
    docs += [(100, None, "x"), (101, "", "x"), docs[1], (102, items[0][1] * 40, "x"), (None, items[0][1], "x")]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(*frames).where("run > 0").collect()}
    want = set()
    for d, t, _ in docs:
        for i, s in items:
            x, y = leakage.normal(t), leakage.normal(s)
            if d is not None and i is not None and any(y[k : k + 40] in x for k in range(len(y) - 39)):
                want.add((d, i))
    assert got == want and len(want) > 25
    none = spark.createDataFrame([], ITEMS)
    assert leakage.leaks(spark.createDataFrame(docs, DOCS), none).isEmpty()


def test_paraphrases_with_few_known_grams(spark):
    rnd = random.Random(3)
    say = lambda n: "".join(rnd.choice("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호") for _ in range(n))
    items = [(i, say(90) + str(100 + i) + say(90)) for i in range(8)]
    docs = []
    for d in range(24):
        t = list(items[d % 8][1])
        for k in range(7, len(t), 15):
            if not t[k].isdigit():
                t[k] = "뷁"
        # a verbatim scrap of 30 characters, more like the item's windows than any passage of the paraphrase
        docs.append((d, say(400) + "".join(t) + say(700) + items[d % 8][1][20:50] + say(600), "x"))
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    rows = leakage.leaks(*frames).where("common_share >= 0.6 and answer_kept").collect()
    got = {(r.doc_id, r.item_id): r.common_share for r in rows}
    assert set(got) == {(d, d % 8) for d in range(24)} and min(got.values()) > 0.9 and not any(r.run for r in rows)


WORDS = "공시 매출 설비 공장 금액 계약 거래 연구 재고 이자 환율 원료 제품 수출 시장 고객 품질 인증 특허 감사 이사 주주 배당 차입 상환 보증 담보 소송 판결 규정 안전 환경 배출 전력 용수 물류 창고 납품 단가 원가".split()


def paraphrase(rnd, text):
    """Every fourth word another, some neighbours swapped, and often the halves in the other order."""
    words = text.split()
    for i in range(rnd.randrange(4), len(words), 4):
        if not any(c.isdigit() for c in words[i]):
            words[i] = rnd.choice(WORDS) + "등"
    for i in range(rnd.randrange(5), len(words) - 1, 9):
        words[i], words[i + 1] = words[i + 1], words[i]
    half = len(words) // 2
    return " ".join(words[half:] + words[:half] if rnd.random() < 0.4 else words)


def test_recall_of_paraphrases(spark):
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choice("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호") for _ in range(rnd.randint(2, 4))) + rnd.choice(["은", "를", "에", "의", "", "고"])
    say = lambda n: " ".join(rnd.choice(WORDS) if rnd.random() < 0.4 else word() for _ in range(n))
    items = [(i, f"{say(22)} {100 + i}개 {say(22)} {2000 + i}.", "x") for i in range(40)]
    docs = [(d, f"{say(60)} {paraphrase(rnd, items[d % 40][1])} {say(80)}", "x") for d in range(120)] + [(1000 + d, say(200), "x") for d in range(60)]
    rows = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where(f"run > 0 or (common_share >= {leakage.SHARE} and answer_kept)").collect()
    got, want = {(r.doc_id, r.item_id) for r in rows}, {(d, d % 40) for d in range(120)}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2 and sum(not r.run for r in rows) > 60


def test_items_of_one_pattern_are_no_leaks_of_each_other(spark):
    rnd = random.Random(47)
    name = lambda: "".join(rnd.choice("bdfghklmprstvz") + rnd.choice("aeio") for _ in range(4))
    ask = lambda: f"Read the filing passage and answer. The {name()} clause lets {name()} hold 39 crates of {name()} at the {name()} depot until {name()} confirms the {name()} terms of the {name()} panel."
    items = [(i, ask(), "x") for i in range(30)]
    docs = [(d, f"{ask()} {ask()}", "x") for d in range(40)] + [(100 + d, "New: " + items[d][1].replace("passage", "text").replace("confirms", "has confirmed"), "x") for d in range(10)]
    rows = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where(f"run > 0 or (common_share >= {leakage.SHARE} and answer_kept)").collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(100 + d, d) for d in range(10)}


def test_recall_of_the_index_and_blocks_of_items(spark, monkeypatch):
    rnd = random.Random(43)
    say = lambda n: "".join(rnd.choice("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허12345") for _ in range(n))
    items = [(i, say(300)) for i in range(60)]
    held = leakage.Items(items)
    docs = [say(100) + items[d % 60][1][(s := rnd.randrange(200)) : s + 70] + say(60) for d in range(400)]
    found = [held.passages(leakage.normal(t)) for t in docs]
    rows = leakage.Rows([k for _, _, ks, _ in found for k in ks], [u for *_, us in found for u in us])
    idf = np.log((sum(n for n, *_ in found) + 1) / (np.bincount(rows.flat, minlength=len(held.vocabulary)) + 1)).astype(np.float32) + np.float32(0.01)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((leakage.FEATURES, leakage.RANK)))[0].astype(np.float32)
    w, _ = rows.weights(idf)
    # the leading directions of these rows, so that the latent space holds most of them
    dense = np.zeros((len(rows), leakage.FEATURES), np.float32)
    np.add.at(dense, (np.repeat(np.arange(len(rows)), rows.sizes), held.column[rows.flat]), w)
    basis = np.ascontiguousarray(np.linalg.qr(dense.T @ (dense @ basis))[0])
    index = leakage.Index(held, idf, basis)
    near = lambda probes: {(r, i) for r, i, _ in zip(*(v.tolist() for v in index.candidates(held, rows, idf, basis, probes)))}
    assert len(near(leakage.PROBES) & near(10**9)) >= 0.9 * len(near(10**9)) > 100
    frames = spark.createDataFrame([(d, t, "x") for d, t in enumerate(docs[:40])], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    whole = {(r.doc_id, r.item_id, r.run) for r in leakage.leaks(*frames).where("run > 0").collect()}
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", 25)
    assert {(r.doc_id, r.item_id, r.run) for r in leakage.leaks(*frames).where("run > 0").collect()} == whole and len(whole) >= 40


def test_passages_of_many_texts():
    rnd = random.Random(53)
    say = lambda n: "".join(rnd.choice("가나다라마바사아자차카타파하 거너더러머 1２３Ａb_") for _ in range(n))
    items = [(i, say(150)) for i in range(6)] + [(6, "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇 ΟΔΟΣ ﬁle")]
    held = leakage.Items(items)
    words = {leakage.normal(t)[k : k + leakage.N] for _, t in items for k in range(len(leakage.normal(t)) - leakage.N + 1)}
    half = items[0][1][:40]
    docs = [None, "", "_", half[:20], half[20:], "ΟΔΟΣ", "😀" * 70, "𠀀𠀁𠀂_𠀃𠀄😀𠀅𠀆 x", "e\u0301" * 80] + [items[k % 7][1][k % 50 : k % 50 + k] + "".join(chr(rnd.choice([rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000), rnd.randrange(128)])) for _ in range(k)) + items[k % 5][1] * (k % 3) for k in range(120)]
    want, total = [], 0
    for d, t in enumerate(docs):
        x = leakage.normal(t)
        total += len(range(0, max(1, len(x) - leakage.WINDOW + leakage.STRIDE), leakage.STRIDE)) if x else 0
        for s in range(0, max(0, len(x) - leakage.N + 1), leakage.STRIDE):
            own = [x[k : k + leakage.N] for k in range(s, min(s + leakage.SPAN, len(x) - leakage.N + 1))]
            if known := [g for g in own if g in words]:
                want.append((d, s, sorted({int(np.searchsorted(held.vocabulary, leakage.grams(g)[0])) for g in known}), len(own) - len(known)))
    for chunk in (leakage.CHUNK, 500):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(leakage, "CHUNK", chunk)
            count, doc, start, rows = held.passages_of(docs)
        known = [p.tolist() for p in np.split(rows.flat, rows.starts[1:])]
        assert count == total and list(zip(doc.tolist(), start.tolist(), known, rows.unknown.tolist())) == want and len(want) > 300
    assert held.passages_of([])[0] == 0 and len(held.passages_of([None, "xyz"])[3]) == 0


def test_products_of_repeated_passages(spark):
    rnd = random.Random(59)
    items = [(i, "".join(rnd.choice("가나다라마바사아자차카타") for _ in range(120))) for i in range(5)]
    held = leakage.Items(items)
    docs = [(d, items[d % 5][1][: 30 + d % 90] + "뷁" * (d % 4), "x") for d in range(300)] + [(900, "xyz", "x")]
    _, _, _, rows = held.passages_of([t for _, t, _ in docs])
    idf = np.linspace(1, 2, len(held.vocabulary), dtype=np.float32)
    w, share = rows.weights(idf)
    dense = np.zeros((len(rows), leakage.FEATURES))
    np.add.at(dense, (np.repeat(np.arange(len(rows)), rows.sizes), held.column[rows.flat]), w * np.repeat(share, rows.sizes))
    right = np.random.default_rng(1).standard_normal((leakage.FEATURES, 9)).astype(np.float32)
    shared = spark.sparkContext.broadcast(held)
    passages = leakage._passages(spark.createDataFrame(docs, DOCS), shared).persist()
    assert passages.where("known is not null").count() == len(rows)
    got = leakage._product(passages, shared, idf, right)
    assert np.allclose(got, dense.T @ (dense @ right), rtol=1e-3, atol=1e-3) and np.abs(got).max() > 1
    passages.unpersist()


def test_answers_cost_little_more_than_their_items_grams():
    rnd = random.Random(61)
    texts = ["".join(rnd.choice("가나다라마바사아자차카타파하거너더러머버서") for _ in range(250)) for _ in range(400)]

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    base = min(seconds(lambda: [np.unique(leakage.grams(y, leakage.OWN)) for y in texts]) for _ in range(3))
    assert min(seconds(lambda: leakage.Answers(texts)) for _ in range(3)) < 20 * base
    sets = [{y[k : k + leakage.OWN] for k in range(len(y) - leakage.OWN + 1)} for y in texts]
    n = collections.Counter(g for s in sets for g in s)
    assert [len(o) for o in leakage.Answers(texts).own] == [sum(n[g] == 1 for g in s) for s in sets]


def test_subsequence():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            corner = 0
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
        assert leakage.subsequence(a, b) == row[-1]


def test_levels_learn_from_graded_text(spark):
    rnd = random.Random(7)
    easy, hard = ["빵을 팝니다.", "모자가 쌉니다.", "손님이 왔습니다.", "가게가 있습니다."], ["유효이자율은 우발대가에 종속됩니다.", "현금창출단위의 손상차손을 전제로 배분합니다.", "선취특권의 효력이 대항될 수 있음을 전제합니다."]
    docs, labels = [], []
    for d in range(240):
        top = d % 2 == 0
        docs.append((d, " ".join(rnd.choice(hard if top else easy) for _ in range(12)), "x"))
        if d < 160:
            labels += [(d, "A", 5 if top else 1), (d, "B", 4 if top and d % 7 == 0 else 5 if top else 1), (d, "C", None)]
    docs += [(900, None, "x"), (901, "", "x"), (902, "빵을 팝니다. " * 4000, "x")]
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string, level string"), spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    got = {r.doc_id: r.level for r in level.levels(d, lab).collect()}
    assert len(got) == 243 and sum((got[i] == 5) == (i % 2 == 0) for i in range(160, 240)) >= 78 and got[902] < 5
    assert {r.level for r in level.levels(d, lab.limit(0)).collect()} == {3}


def test_word_grades_are_over_all_graded_documents(spark):
    words = ["빵", "모자", "우발대가", "손상차손", "가게", "법인"]
    d = spark.createDataFrame([(i, " ".join([words[i % 6], words[i % 5], f"말{'가나다라마'[i % 5]}"])) for i in range(60)], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, "A", 1 + i % 5) for i in range(50)], "doc_id bigint, rater string, level int")
    few, every = (level.train(d, lab, n)[0] for n in (8, 1000))
    n, s = collections.Counter(), collections.Counter()
    for i, text in ((r.doc_id, r.text) for r in d.collect() if r.doc_id < 50):
        for b in set(level.buckets(text, level._Words()).tolist()):
            n[b] += 1
            s[b] += 1 + i % 5
    for t in (few, every):
        assert {b: t["graded_n"][b] for b in np.flatnonzero(t["graded_n"])} == n and {b: t["graded_s"][b] for b in np.flatnonzero(t["graded_s"])} == s
        assert t["mean"] == pytest.approx(3.0)


def test_labels_follow_a_long_chain(spark):
    base = "이 문서는 관리자가 아직 올리지 않았으니 담당 부서로 연락한 뒤에 다시 열람하여 주시기를 부탁드립니다 감사합니다"
    chain = [base]
    for k in range(0, 54, 2):  # each link changes two characters more, far ends have little in common
        chain.append(chain[-1][:k] + "거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후기니디리미비시이지치키티피히"[k : k + 2] + chain[-1][k + 2 :])
    rows = [(i, t, "message" if i == 0 else None) for i, t in enumerate(chain)]
    assert residue.similarity(chain[0], chain[-1]) < 0.3
    got = {r.uid for r in residue.residue_units(units(spark, rows)).collect()}
    near = {i for i in range(1, len(chain)) if residue.similarity(chain[i - 1], chain[i]) >= residue.SIMILAR}
    assert near == set(range(1, len(chain))) and got == set(range(len(chain)))
