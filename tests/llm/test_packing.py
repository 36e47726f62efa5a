import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sheaf.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_tokenizer(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["It's <|endoftext|> a'b <|ENDOFTEXT|>x  y \x00 z é ΣΣ \x85q", "", "   ", "ÀÉ, Öß. straße ẞ İx K a.b ..a a.., 12ab,",
             "don't can'T 'tis ,' '   x y ́a ó. Å", "Hello hello, HELLO. hello,, (hello)", "日本語 テスト。 a日本, ab日.", "a\x1cb\x1d c\x85d\u3000e\u2028f\xa0g \x0bh\x0ci\rj"]
    words = packing.WordIds(PATH)
    assert words.plain
    for _ in range(2):
        ids, n = words.ids(pa.array([*texts, None]))
        want = [e.ids for e in tok.encode_batch([*texts, ""], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    other = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.plain


def check(pieces, rows, window=2048):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            part = np.array(ids[at:at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, zlib.crc32(part)) == (at, len(ids), zlib.crc32(p.ids)) and p.length > 0
            at += p.length
        assert at == len(ids)
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        assert [p.offset for p in seq] == np.append(0, np.cumsum([p.length for p in seq])[:-1]).tolist()
        assert sum(p.length for p in seq) == seq[0].sequence_tokens <= window
    return by_seq


def test_round_trip(spark, docs):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Ab,", "cdé", "x1", "\n", "zz."]) for _ in range(r.choice([0, 5, 90, 700, 3000, 9000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "aaaa" * 5000)]
    df = docs(rows).repartition(5)
    seqs = check(packing.pack(df, open_windows=4).collect(), rows)
    total = sum(s[0].sequence_tokens for s in seqs.values())
    assert len(seqs) - total // 2048 <= 2 + 0.01 * len(seqs)
    seqs = check(packing.pack(df, open_windows=3, merge_partitions=2, min_cut=2048).collect(), rows)
    assert len(seqs) * 2048 < 1.5 * total


def test_edge_cases(spark, docs):
    rows = [(None, "a b"), (None, "a b"), (7, None), (7, "c")]
    df = docs(rows).selectExpr("*", "'x' AS ids", "1 AS sequence_id")
    got = packing.pack(df).collect()
    assert sorted((str(p.doc_id), p.doc_tokens) for p in got) == [("7", 1), ("7", 2), ("None", 3), ("None", 3)]
    assert packing.pack(docs([])).count() == 0


def test_packer_places_best_fit_and_emits_the_fullest():
    p = packing.Packer(10, 2, 100)
    ids = np.arange(30, dtype=np.uint32)
    for row, n in (("a", 6), ("b", 8), ("c", 2), ("d", 9), ("e", 4)):
        p.put(row, 0, ids[:n])
    assert [[r for r, _, _ in w] for _, w in p.done] == [["b", "c"], ["a", "e"]]
    assert [[r for r, _, _ in w] for _, w in p.leftovers()] == [["d"]]
    p.put("f", 0, ids)
    assert [len(w[0][2]) for _, w in p.done[2:]] == [10, 10, 10]
