import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import collinear_chains as cc


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def edited(r, w, rate):
    out = []
    for x in w:
        k = r.random()
        out += [] if k < rate / 3 else [words(r, 1)[0]] if k < 2 * rate / 3 else [x, words(r, 1)[0]] if k < rate else [x]
    return out


def test_exact_repeats_against_brute_force(docs):
    r = random.Random(1)
    shared = [words(r, n) for n in (50, 60, 200, 49, 55)]
    rows = []
    for i in range(60):
        parts = [words(r, r.randint(0, 80)) + r.choice([[], r.choice(shared), shared[0]]) for _ in range(3)]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w if r.random() < .5 else w.upper() for p in parts for w in p)))
    rows += [(100 + i, rows[5][1]) for i in range(40)]
    seen, want = set(), {}
    for i, text in sorted(rows):
        w = text.lower().split()
        for p in range(len(w) - 49):
            if (key := tuple(w[p:p + 50])) in seen:
                want.setdefault(i, set()).update(range(p, p + 50))
            seen.add(key)
    got, split = {}, {i: np.array(text.lower().split()) for i, text in rows}
    found = cc.passages(docs(rows).repartition(4)).collect()
    for x in found:
        assert x.ref_doc_id < x.doc_id or (x.ref_doc_id == x.doc_id and x.ref_start < x.start_word)
        if x.similarity < 1:  # passages with edits between frequent parts: right, but none of the windows above
            a, b = split[x.doc_id][x.start_word:x.end_word], split[x.ref_doc_id][x.ref_start:x.ref_end]
            assert len(a) >= 50 and 2 * cc.common(a, b) / (len(a) + len(b)) >= .8
            continue
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
    assert {k: sorted(v ^ got.get(k, set())) for k, v in want.items() if v != got.get(k)} == {} and set(got) == set(want)
    assert sum(x.doc_id >= 100 for x in found) < 400


def test_fuzzy_passages_are_found_and_clean_text_is_not(docs):
    r = random.Random(2)
    rows, planted = [], []
    for i in range(40):
        p = words(r, 120)
        rows += [(2 * i, " ".join(words(r, 50) + p + words(r, 50))), (2 * i + 1, " ".join(words(r, 30) + edited(r, p, .08) + words(r, 60)))]
        planted.append((2 * i + 1, 2 * i))
    rows += [(1000 + i, " ".join(words(r, 300))) for i in range(40)]
    found = cc.passages(docs(rows)).collect()
    assert {(x.doc_id, x.ref_doc_id) for x in found} == set(planted)
    assert all(x.similarity >= .8 and 50 <= x.end_word - x.start_word < 150 for x in found)
    assert sum(x.end_word - x.start_word for x in found) > 40 * 100


def test_chains_are_best_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        parts = np.array(sorted([a, r.randint(0, 40), a + r.randint(0, 5)] for a in (r.randint(0, 40) for _ in range(r.randint(1, 7)))))
        rows = parts.tolist()
        best = [0.0] * len(rows)
        for i, (a, b, last) in enumerate(rows):
            gains = [best[j] - cc.GAP_COST * (a - p[2] - 1 + b - (p[1] + p[2] - p[0] + 1)) for j, p in enumerate(rows)
                     if p[2] + 1 <= a and p[1] + p[2] - p[0] + 1 <= b]
            best[i] = last - a + cc.K + max([0.0, *gains])
        chain = cc.chains(parts)[0]
        assert sorted(i for c in cc.chains(parts) for i in c) == list(range(len(rows)))
        score = sum(rows[i][2] - rows[i][0] + cc.K for i in chain) - cc.GAP_COST * sum(
            rows[n][0] - rows[i][2] - 1 + rows[n][1] - (rows[i][1] + rows[i][2] - rows[i][0] + 1) for i, n in zip(chain, chain[1:]))
        assert abs(score - max(best)) < 1e-9


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(100):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert cc.common(np.array(a), np.array(b)) == t[-1][-1]


def test_removal_keeps_the_earliest(docs):
    r = random.Random(5)
    p, one, two = words(r, 70), words(r, 30), words(r, 30)
    same = " ".join(words(r, 90))
    rows = [(9, " ".join(one + p) + "\nend."), (3, " ".join(p + two)), (5, same), (7, same), (7, same), (None, None), (None, " ".join(words(r, 60))),
            (11, "x y " * 40_000), (12, ""), (13, " ".join(words(r, 60))), (13, " ".join(words(r, 60)))]
    df = docs(rows).withColumn("n_chars", F.lit(-1)).withColumn("__key", F.lit("a")).withColumnRenamed("__key", "ref")
    out = cc.remove(df)
    assert out.dtypes == df.dtypes
    got = {}
    for x in out.collect():
        got.setdefault(x.doc_id, []).append(x.text)
        assert x.text is None or x.n_chars == len(x.text)
    assert got[9] == [" ".join(one) + " end."] and got[3] == [rows[1][1]] and got[5] == [same] and 7 not in got
    assert len(got[None]) == len(got[13]) == 2 and got[12] == [""] and len(got[11][0].split()) < 100
    assert cc.passages(docs([])).count() == 0 and cc.remove(docs([])).count() == 0


def test_a_long_chain_with_equal_gaps_is_cut_without_recursion():
    def cut(a, b, parts):  # the definition: at the first widest gap, again and again
        gaps = [(p[0] + p[2], n[0], p[1] + p[2], n[1]) for p, n in zip(parts, parts[1:])]
        wide = [max(g[1] - g[0], g[3] - g[2]) for g in gaps]
        if not wide or max(wide) <= cc.MAX_GAP:
            end, cend = parts[-1][0] + parts[-1][2], parts[-1][1] + parts[-1][2]
            same = sum(p[2] for p in parts) + sum(cc.common(a[g[0]:g[1]], b[g[2]:g[3]]) for g in gaps)
            like = 2 * same / (end - parts[0][0] + cend - parts[0][1])
            if like >= .8:
                return [(parts[0][0], end, parts[0][1], cend, like)] if end - parts[0][0] >= 50 else []
            if not wide:
                return []
        at = 1 + wide.index(max(wide))
        return cut(a, b, parts[:at]) + cut(a, b, parts[at:])

    r = random.Random(6)
    for _ in range(100):
        a, b, parts = [], [], []
        for _ in range(r.randint(1, 20)):
            n = r.randint(5, 40)
            parts.append((len(a), len(b), n))
            run = [r.randint(0, 9) for _ in range(n)]
            a += run + [r.randint(0, 3) for _ in range(r.choice([1, 5, 5, 9, 40]))]
            b += run + [r.randint(0, 3) for _ in range(r.choice([1, 5, 5, 9, 40]))]
        a, b = np.array(a), np.array(b)
        assert cc._passages(a, b, parts, 50, .8) == cut(a, b, parts)
    n = 1500
    a, b = np.arange(46 * n), np.arange(46 * n)
    b[np.arange(46 * n) % 46 >= 30] = -1
    parts = [(46 * i, 46 * i, 30) for i in range(n)]
    assert cc._passages(a, b, parts, 50, .8) == []
    assert len(cc._passages(a, b, parts, 20, .8)) == n


def test_exact_repeats_of_frequent_parts_are_found(docs):
    r = random.Random(7)
    rows = []
    for g in range(60):
        one, two = words(r, r.choice([30, 45, 49])), words(r, r.choice([30, 45, 5]))
        own = [words(r, r.randint(0, 40)) for _ in range(6)]
        holds = [one, two, one + two, one, two, one + two]
        rows += [(6 * g + i, " ".join(x + w)) for i, (x, w) in enumerate(zip(own, holds))]
    # hot in a slice of documents, too: only the first goes on from there
    one, two = words(r, 30), words(r, 30)
    rows += [(1000 + i, " ".join(words(r, 9) + (one + two if i in (40, 50) else r.choice([one, two])))) for i in range(100)]
    seen, want = set(), {}
    for i, text in rows:
        w = text.split()
        for p in range(len(w) - 49):
            if (key := tuple(w[p:p + 50])) in seen:
                want.setdefault(i, set()).update(range(p, p + 50))
            seen.add(key)
    for parts in (1, 7):
        got = {}
        for x in cc.passages(docs(rows).repartition(parts, "doc_id")).collect():
            got.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
        assert len(want) > 40 and {k for k, v in want.items() if v - got.get(k, set())} == set()


def test_open_windows_against_brute_force():
    r = random.Random(8)
    for _ in range(20):
        counts = np.array([r.randint(0, 200) for _ in range(4)])
        hashes = np.array([r.getrandbits(64) for _ in range(counts.sum())], np.uint64)
        starts = np.cumsum(counts) - counts
        _, text, pos = cc.seeds(hashes, counts)
        place = pos + starts[text]
        rich = place[[r.random() < .9 for _ in place]]
        got = set(zip(*(x.tolist() for x in cc.windows(hashes, counts, rich, 50)[1:])))
        for t, (start, n) in enumerate(zip(starts, counts)):
            for p in range(n - 49):
                own = cc.seeds(hashes[start + p:start + p + 50], np.array([50]))[2] + start + p
                poor = sorted(set(own.tolist()) - set(rich.tolist()))
                decided = bool(poor) and poor[-1] - poor[0] >= cc.SPREAD
                assert decided or (t, p) in got  # what its own seeds do not decide is hashed


def test_recall_of_fuzzy_passages_against_brute_force(docs):
    """Planted pairs with replaced words; what counts is decided by all sub-windows: ends that agree, 50 words, 0.8."""
    r = random.Random(9)
    kinds = {"55 every 6": (55, 6, 0), "60 every 6": (60, 6, 0), "80 every 6": (80, 6, 0), "60 every 8": (60, 8, 0),
             "55 with 8": (55, 0, 8), "52 with 8": (52, 0, 8), "60 with 10": (60, 0, 10), "60 with 12": (60, 0, 12)}
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 8))) for _ in range(3000)]
    rows, planted = [], []
    for kind, (n, every, some) in kinds.items():
        for _ in range(40):
            one, i = r.choices(vocabulary, k=n), len(rows)
            places = range(every // 2, n, every) if every else r.sample(range(n), some)
            two = [r.choice(vocabulary) if j in places else w for j, w in enumerate(one)]
            agree = np.cumsum([0] + [x == y for x, y in zip(one, two)])
            counts = any(one[s] == two[s] and one[e - 1] == two[e - 1] and agree[e] - agree[s] >= .8 * (e - s)
                         for s in range(n) for e in range(s + 50, n + 1))
            before = r.randrange(20, 200)
            rows.append((i, " ".join(r.choices(vocabulary, k=r.randrange(20, 200)) + one + r.choices(vocabulary, k=100))))
            rows.append((i + 1, " ".join(r.choices(vocabulary, k=before) + two + r.choices(vocabulary, k=100))))
            if counts:
                planted.append((kind, i + 1, before, before + n))
    found = {}
    for x in cc.passages(docs(rows).repartition(4)).collect():
        found.setdefault((x.doc_id, x.ref_doc_id), []).append((x.start_word, x.end_word, x.similarity))
    hit = {kind: [] for kind in kinds}
    for kind, doc, lo, hi in planted:
        hit[kind].append(any(min(hi, e) - max(lo, s) >= .8 * (hi - lo) for s, e, _ in found.get((doc, doc - 1), [])))
    recall = {kind: sum(h) / len(h) for kind, h in hit.items()}
    assert all(v >= .85 for v in recall.values()) and sum(map(sum, hit.values())) >= .93 * len(planted), recall
    assert all(b == a - 1 and like >= .8 and e - s >= 50 for (a, b), x in found.items() for s, e, like in x)
    clean = [(i, " ".join(r.choices(vocabulary, k=400))) for i in range(100)]
    assert cc.passages(docs(clean)).count() == 0


@pytest.mark.parametrize("crowd", [64, 2, 1])
def test_a_fuzzy_passage_of_which_every_seed_is_frequent_elsewhere(docs, monkeypatch, crowd):
    """Each 4-word part of the passage is first, and last before the later document, in texts that hold 12 words of it."""
    monkeypatch.setattr(cc, "CROWD", crowd)
    r = random.Random(11)
    passages, rows = [words(r, 60) for _ in range(4)], []
    for g, p in enumerate(passages):
        for i in range(0, 60, 8):
            rows += [(at + 10 * g + i // 8, " ".join(words(r, 20) + p[i:i + 12] + words(r, 20))) for at in (100, 200, 700, 800)]
        late = [w if i % 12 != 11 else words(r, 1)[0] for i, w in enumerate(p)]
        rows += [(500 + g, " ".join(words(r, 30) + p + words(r, 30))), (900 + g, " ".join(words(r, 30) + late + words(r, 30)))]
    found = cc.passages(docs(rows)).collect()
    assert {(x.doc_id, x.ref_doc_id) for x in found} == {(900 + g, 500 + g) for g in range(4)}
    assert all(x.end_word - x.start_word >= 50 and x.similarity >= .8 for x in found)


def test_a_line_of_very_many_texts_links_each_with_few(docs, monkeypatch):
    """A line that all texts hold is a class: its links grow with the texts, not with their pairs."""
    monkeypatch.setattr(cc, "CROWD", 5)
    r, links, rest = random.Random(12), [], cc.rest
    line = words(r, 40)
    monkeypatch.setattr(cc, "rest", lambda *args: links.append(rest(*args)) or links[-1])
    rows = [(i, " ".join(words(r, 60) + line + words(r, 60))) for i in range(80)]
    assert cc.passages(docs(rows)).count() == 0
    assert links[0].count() <= 3 * len(rows)


def linked_by_definition(texts, spans):
    """Links of ``rest``: rows (ref, cref, pos, cpos), from ``{ref: [(pos, code)]}`` and ``{ref: [(start, end)]}``."""
    by_key = {}
    for ref, seen in texts.items():
        covered = {w for lo, hi in spans.get(ref, []) for w in range(lo, hi)}
        free = {pos: any(pos + k not in covered for k in range(cc.K)) for pos, _ in seen}
        for p, c in seen:
            for q, d in seen:
                if cc.SPREAD <= q - p <= cc.ALONG and (c % 2 == 0 or d % 2 == 0):
                    by_key.setdefault((c, d), []).append((ref, p, q - p, free[p] or free[q]))
    out = set()

    def link(late, early):
        ends = (early[0], early[1] + early[2]) < (late[0], late[1] + late[2])
        if early[:2] < late[:2] and ends and abs(early[2] - late[2]) <= cc.NEAR:
            out.update({(late[0], early[0], late[1], early[1]), (late[0], early[0], late[1] + late[2], early[1] + early[2])})

    for places in by_key.values():
        if len(places) < 2 or not any(x[3] for x in places):
            continue
        if len(places) <= cc.CROWD:
            [link(x, y) for x in places if x[3] for y in places]
            continue
        first = {gap: min(x for x in places if x[2] == gap) for gap in {x[2] for x in places}}
        [link(x, first[x[2]]) for x in places if x[3]]
        [link(x, y) for x in first.values() for y in first.values()]
    return out


def rest_of(spark, texts, spans):
    pairs = spark.createDataFrame(list(texts.items()), "ref long, seen array<struct<pos: int, code: int>>")
    found = [(ref, *x) for ref, some in spans.items() for x in some]
    found = cc.rest(pairs.repartition(3), spark.createDataFrame(found, "__ref long, start_word long, end_word long"), 2)
    return set() if found is None else {(x.ref, x.cref, a.pos, a.cpos) for x in found.collect() for a in x["at"]}


@pytest.mark.parametrize(("hot", "crowd"), [(16, 8), (4, 3)])
def test_the_rest_against_its_definition(spark, monkeypatch, hot, crowd):
    """Also where a slice holds one key very often and sends one place for all of an equal distance."""
    monkeypatch.setattr(cc, "HOT", hot)
    monkeypatch.setattr(cc, "CROWD", crowd)
    r, texts, spans = random.Random(21), {}, {}
    for ref in range(-20, 120):
        texts[ref] = [(pos, r.choice([2, 3, 4, 5, 5, 6] if ref % 3 else range(7, 90))) for pos in sorted(r.sample(range(150), r.randint(2, 12)))]
        if ref % 2:
            spans[ref] = [(lo, lo + 60) for lo in r.sample(range(120), 2)]
    assert rest_of(spark, texts, spans) == linked_by_definition(texts, spans)
    assert rest_of(spark, {1: [(0, 2), (9, 4)], 2: [(0, 6), (9, 8)]}, spans) == set()


def test_a_seed_that_is_covered_everywhere_still_counts_beside_an_open_one(spark):
    """Passages cover the first seed of both texts; the second lies open and needs the first beside it."""
    texts, spans = {1: [(0, 2), (10, 4)], 2: [(0, 2), (10, 4)]}, {1: [(0, 6)], 2: [(0, 6)]}
    assert rest_of(spark, texts, spans) == {(2, 1, 0, 0), (2, 1, 10, 10)}


def test_a_seed_is_not_its_own_anchor(spark):
    """A text with one seed twice before another: both twos end at the same place."""
    assert rest_of(spark, {1: [(0, 2), (4, 2), (14, 4)]}, {}) == set()


def test_seeds_two_by_two_that_no_other_text_has_are_not_stored(docs, monkeypatch):
    """Frequent phrases in random order: some 20,000 twos, of which few occur again."""
    r, stored, rows = random.Random(13), cc.stored, []
    monkeypatch.setattr(cc, "stored", lambda df, label: (lambda table: rows.append((label, table.count())) or table)(stored(df, label)))
    phrases = [words(r, 6) for _ in range(1000)]
    texts = [(i, " ".join(sum(r.sample(phrases, 100), []))) for i in range(40)]
    assert cc.passages(docs(texts)).count() == 0
    assert max(n for _, n in rows) <= 5000, rows
