import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from sheaf.llm import piece_encoding
from sheaf.llm.queries import QUERIES, read

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aabbcdehinorst  \n\t▁éüñçß'’,.!?0123日本語😀\ue000\x00\x85　 ЖдиAB"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return piece_encoding.Pieces(PATH)


def test_random_texts_equal_the_library(own, library):
    r = random.Random(1)
    texts = ["", " ", "▁", "a" * 3000, "ab" * 2000, " " * 500, "\n" * 50, "x" * 33 + " " * 33]
    texts += ["".join(r.choices(LETTERS, k=r.randrange(40))) for _ in range(4000)]
    texts += [" " * r.randrange(60) + "x" * r.randrange(50) + " " * r.randrange(60) for _ in range(500)]
    for text, ids in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        assert own.encode(text) == ids.tolist() == library.encode(text), text


def test_random_ids_decode_like_the_library(own, library):
    r = random.Random(2)
    few, all_ = [0, 1, 2, 259, 260, 29871, 200, 230, 198, 131], [13, 1, 2, 259, 306, 29871]
    rows = [[r.choice([*few, r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randrange(8))] for _ in range(4000)]
    rows += [[r.choice([*all_, r.randrange(300, 20000)]) for _ in range(r.randrange(8))] for _ in range(4000)]
    for ids, text in zip(rows, own.decode_all(pa.array(rows, pa.list_(pa.int32()))).to_pylist(), strict=True):
        assert own.decode(ids) == text == library.decode(ids), ids
    assert own.decode_all(pa.array([None, [306], []], pa.list_(pa.int32())).slice(0)).to_pylist() == ["", library.decode([306]), ""]


def test_backtracking_drops_pieces_and_agrees_with_the_merges(own):
    words = ["▁thnt", "▁heheon", "aaaaaaa", "▁▁▁▁▁x", "qqzz日日", "ounouing", "eedesses"]
    greedy = 0
    for word in words:
        assert own.split(word) == own.merge(word)
        longest, at, row = own.longest(word), 0, []
        while at < len(word):
            row.append(longest[at])
            at += len(longest[at])
        greedy += row != own.merge(word)
    assert greedy  # longest match alone would be wrong


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        piece_encoding.Pieces(str(tmp_path / "none.model"))


def expected(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_eos=True)
        out.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows_and_clashing_columns(spark, library):
    rows = [(1, None), (2, ""), (3, "   "), (None, "null id"), (4, "same"), (4, "same"), (5, "long " * 60_000), (6, "▁ \t日")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, pieces string, __ids int")
    assert sorted(map(tuple, piece_encoding.digests(docs).collect()), key=repr) == expected(library, rows)
    both = piece_encoding.decode(piece_encoding.encode(docs))
    assert both.columns == ["doc_id", "text", "pieces", "__ids", "ids", "decoded"] and both.filter("pieces = 'x' AND __ids = 7").count() == len(rows)
    assert docs.columns == ["doc_id", "text", "pieces", "__ids"]
    assert piece_encoding.digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        piece_encoding.encode(docs, into="pieces")


def test_query_equals_the_library_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op12_piece_encoding"](spark, sf).collect()), key=repr) == expected(library, rows)


def test_decoding_takes_a_bounded_count_of_ids_at_a_time(own, monkeypatch):
    """Spark hands over 10,000 rows at once, however long; decoding takes many times the bytes of its ids."""
    r, sizes = random.Random(9), []
    rows = [None, [], *([r.randrange(300, 900) for _ in range(r.randint(0, 60))] for _ in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])
    want = own.decode_all(batch.column(1)).to_pylist()
    monkeypatch.setattr(piece_encoding, "_SLICE_IDS", 100)

    class Recorder:
        def decode_all(self, ids):
            sizes.append(len(ids.flatten()))
            return own.decode_all(ids)

    out = list(piece_encoding._decoded(iter([batch, batch.slice(0, 0), batch.slice(50, 100)]), Recorder(), "ids", "decoded"))
    assert max(sizes) < 100 + 60
    assert pa.Table.from_batches(out).column("decoded").to_pylist() == want + want[50:150]
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == [*range(len(rows)), *range(50, 150)]
