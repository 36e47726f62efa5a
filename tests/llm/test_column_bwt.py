import random

import numpy as np
import pytest

from sheaf.llm import column_bwt as cb


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i:i + length]] = count.get(d[i:i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = True
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)
        out.append((len(d), [tuple(x) for x in turn.tolist()], bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(df, rows, length):
    got = sorted((str(r.doc_id), r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in cb.remove(df, length=length).collect())
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length), strict=True))
    assert got == want


def text(r, n, letters="abcdefghijklmnop é\n"):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("length", [40, 400])
def test_against_brute_force(docs, length):
    r = random.Random(length)
    shared = [text(r, n) for n in (length - 1, length, length + 1, 3 * length, 9 * length)]
    rows = []
    for i in range(70):
        t = "".join(text(r, r.randint(0, 2 * length)) + r.choice(["", *shared]) for _ in range(3))
        if r.random() < .3:
            at = r.randrange(len(t) + 1)
            t = t[:at] + "#" + t[at + 1:]
        rows.append((i, t))
    for i in range(100, 130):
        base = rows[r.randrange(70)][1]
        at = r.randrange(len(base) + 1)
        rows.append((i, base[:at] + r.choice(["", "x", "yz"]) + base[at:]))
    check(docs(rows).repartition(5), rows, length)


def test_a_crowded_key_is_dealt_by_strings(docs, monkeypatch):
    """One passage between differing texts in every document, longer than a string, cut short here and there."""
    r = random.Random(21)
    passage = text(r, 150)
    rows = []
    for i in range(260):
        lo, hi = (0, 150) if r.random() < .7 else sorted((r.randrange(60), 90 + r.randrange(60)))
        rows.append((i, text(r, r.randrange(60)) + passage[lo:hi] + text(r, r.randrange(60)) + (passage[20:70] if i % 9 == 0 else "")))
    df = docs(rows).repartition(4)
    check(df, rows, 40)
    monkeypatch.setattr(cb, "CROWD", 20)
    check(df, rows, 40)


def test_low_complexity_and_overlaps(docs):
    r = random.Random(9)
    rows = [(1, "a" * 90), (2, "ab" * 60), (3, "abc" * 30 + text(r, 50)), (4, text(r, 30, "ab") * 5), (5, "a" * 39), (6, "b" * 40), (7, "c" * 41)]
    check(docs(rows), rows, 40)


def test_edge_cases(docs, monkeypatch):
    from pyspark.sql import functions as F
    r = random.Random(3)
    long = text(r, 3000)
    rows = [(None, None), (None, long), (None, long), (4, ""), (5, long[500:1200]), (5, long[500:1200]), (6, "é" * 500), (7, "é" * 500)]
    check(docs(rows).withColumn("spans", F.lit(1)).withColumn("key", F.lit("c")), rows, 400)
    assert cb.remove(docs([])).count() == 0


def test_chunks_of_long_texts(monkeypatch):
    r = random.Random(4)
    data = text(r, 5000).encode()
    def all_of():
        return [x for place, keys, ctx in cb.anchors(data, 60) for x in zip(place.tolist(), keys.T.tolist(), ctx.tolist(), strict=True)]

    whole = all_of()
    for chunk in (70, 333, 700):
        monkeypatch.setattr(cb, "CHUNK", chunk)
        assert all_of() == whole


def test_construction_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        n, width, length = r.randint(1, 12), 14, 6
        group = np.sort(np.array([r.randint(0, 2) for _ in range(n)]))
        columns = np.array([[r.choice([0, 0, 0, 1, 256]) for _ in range(n)] for _ in range(width)], np.uint16)
        got = cb.construct(group, columns, length)
        for i in range(n):
            for c in range(width - length + 1):
                own = columns[c:c + length, i]
                want = (own < 256).all() and any(j != i and group[j] == group[i] and (columns[c:c + length, j] == own).all() for j in range(n))
                assert got[i, c] == want
