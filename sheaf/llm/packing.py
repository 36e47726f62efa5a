"""Bounded-space online packing of tokenised documents into windows.

Every partition keeps at most ``open_windows`` windows open.  A document's whole windows go out at once; its rest is
placed best-fit, into the open window it leaves fullest.  When none fits, the fullest window is filled with the head
of the rest (where at least ``min_cut`` ids fit) and emitted.  Windows still open at a partition's end are leftovers:
those of ``merge_partitions`` partitions meet in one task, bounded by the number of open windows, where they are laid
end to end.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm.shared import slices, stored

WINDOW = 2048
END_ID = 1
_CACHE_ATOMS = 400_000
_CLOSING = ".,;:!?"
_PLAIN = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[{_CLOSING}]*$"
_tokenizers: dict[str, WordIds] = {}


class WordIds:
    """Ids of white-space separated words, each distinct atom encoded once while the cache lasts.

    The tokenizer splits at white space before anything else and its normaliser works on single characters, so a
    text's ids are its words' ids in a row.  A word of Latin letters and closing punctuation is two atoms, which
    the tokenizer splits too; such letter runs share one lower-case atom where the tokenizer lower-cases.  Atoms of
    letters are encoded many at a time and told apart by the vocabulary's end-of-word tokens; other words, and all
    words of a vocabulary without such tokens, are encoded one by one.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        vocabulary = self.tok.get_vocab(with_added_tokens=False) if suffix else {}
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        probe = [self.tok.encode(x, add_special_tokens=False).ids for x in ("Ab", "ab", "ab,", ",")]
        self.plain = bool(vocabulary) and probe[0] == probe[1] and probe[2] == probe[1] + probe[3]
        self.clear()

    def clear(self) -> None:
        self.atoms: dict[str, int] = {"": 0}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _encode(self, atoms: list[str], letters: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and sizes of ``atoms``."""
        runs = [atoms[i:i + 200] for i in range(0, len(atoms), 200)]
        if not letters:
            found = [[e.ids for e in self.tok.encode_batch_fast(r, add_special_tokens=False)] for r in runs]
            return ([np.fromiter(itertools.chain.from_iterable(f), np.uint32) for f in found],
                    [np.fromiter(map(len, f), np.int64, len(f)) for f in found])
        ids, sizes = [], []
        for run, e in zip(runs, self.tok.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(self.ends[got]) + 1
            one = ([got], [np.diff(cut, prepend=0)]) if len(cut) == len(run) else self._encode(run, False)
            ids += one[0]
            sizes += one[1]
        return ids, sizes

    def _rows(self, atoms: pa.Array, letters: bool) -> np.ndarray:
        """The cache's row of each of ``atoms``, encoding those it lacks."""
        coded = atoms.dictionary_encode()
        names = coded.dictionary.to_pylist()
        fresh = [x for x in names if x not in self.atoms]
        if fresh:
            ids, sizes = self._encode(fresh, letters)
            self.flat = np.concatenate([self.flat, *ids])
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes)))
            self.atoms.update(zip(fresh, range(len(self.atoms), len(self.atoms) + len(fresh)), strict=True))
        return np.fromiter(map(self.atoms.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]

    def _pairs(self, words: pa.Array) -> np.ndarray:
        """The two atoms of each of ``words`` (the second may be the empty one)."""
        out = np.zeros((len(words), 2), np.int64)
        plain = np.zeros(len(words), bool)
        if self.plain:
            some = pc.match_substring_regex(words, _PLAIN)
            plain = some.to_numpy(zero_copy_only=False)
            low = pc.utf8_lower(words.filter(some))
            out[plain, 0] = self._rows(pc.utf8_rtrim(low, _CLOSING), True)
            out[plain, 1] = self._rows(pc.replace_substring_regex(low, f"^.*?([{_CLOSING}]*)$", r"\1"), False)
        out[~plain, 0] = self._rows(words.filter(pa.array(~plain)), False)
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` in a row, and the count of each."""
        if len(self.atoms) > _CACHE_ATOMS:
            self.clear()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        atoms = self._pairs(words.dictionary)[words.indices.to_numpy()].ravel()
        size = np.diff(self.starts)[atoms]
        ends = np.cumsum(size)
        take = np.repeat(self.starts[atoms] - (ends - size), size)
        take += np.arange(len(take))
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        return self.flat[take], np.diff(np.append(0, ends)[2 * at])


def word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


class Packer:
    """Open windows of one task.  A piece is ``(row, start, ids)``; finished windows collect in ``done``."""

    def __init__(self, window: int, open_windows: int, min_cut: int):
        self.window, self.most, self.min_cut = window, open_windows, min_cut
        self.gaps: list[tuple[int, int]] = []  # sorted (gap, window number)
        self.held: dict[int, list] = {}
        self.done: list[tuple[int, list]] = []
        self.number = 0

    def put(self, row, start: int, ids: np.ndarray) -> None:
        while len(ids) >= self.window:
            self.done.append((self._new(), [(row, start, ids[:self.window])]))
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
                self.held[number].append((row, start, ids))
                self._keep(gap - len(ids), number)
                return
            if len(self.gaps) < self.most:
                number = self._new()
                self.held[number] = [(row, start, ids)]
                self._keep(self.window - len(ids), number)
                return
            gap, number = self.gaps.pop(0)  # the fullest
            if gap >= self.min_cut:
                self.held[number].append((row, start, ids[:gap]))
                start, ids = start + gap, ids[gap:]
            self.done.append((number, self.held.pop(number)))

    def _new(self) -> int:
        self.number += 1
        return self.number - 1

    def _keep(self, gap: int, number: int) -> None:
        if gap:
            insort(self.gaps, (gap, number))
        else:
            self.done.append((number, self.held.pop(number)))

    def leftovers(self) -> list[tuple[int, list]]:
        self.gaps, held = [], self.held
        self.held = {}
        return sorted(held.items())


def _piece_rows(windows: list[tuple[int, list]], base: int, is_open: bool) -> Iterator[tuple]:
    for number, pieces in windows:
        offset, total = 0, sum(len(ids) for _, _, ids in pieces)
        for (doc, tokens), start, ids in pieces:
            yield doc, start, len(ids), ids.astype("<u4").tobytes(), tokens, base + number, offset, total, is_open
            offset += len(ids)


_COLUMNS = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         end_id: int = END_ID, open_windows: int = 64, min_cut: int = 16, merge_partitions: int = 64) -> DataFrame:
    """Pack every row of ``docs``; one row per piece.

    Columns: ``doc_id``; ``start``, the ids of its document before it; ``length``; ``ids`` (little-endian unsigned
    32-bit, as bytes); ``doc_tokens``; ``sequence_id``; ``offset`` in that sequence; ``sequence_tokens``.  A null or
    empty text is the end id alone.  Every row is a document of its own, also with a null or repeated ``doc_id``.
    Very long texts fill whole windows.  Every sequence holds ``window`` ids at most; those it lacks are padding.
    An empty table gives no piece.  Other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {_COLUMNS}, __open boolean"
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = Packer(window, open_windows, min_cut), word_ids(path)
        base = TaskContext.get().partitionId() << 32
        kinds = None
        for whole in batches:
            kinds = whole.schema.field(0).type
            for batch in slices(whole, "__text"):
                ids, counts = words.ids(batch.column(1))
                ends = np.cumsum(counts)
                for doc, lo, hi in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    packer.put((doc, hi - lo + 1), 0, np.concatenate([ids[lo:hi], end]))
                yield _batch(_piece_rows(packer.done, base, False), kinds)
                packer.done = []
        if kinds is not None:
            yield _batch(_piece_rows(packer.leftovers(), base, True), kinds)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer(window, 1, 1)
        base = (1 << 62) | (table.column("__group")[0].as_py() << 32)
        cols = [rows.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids")]
        for doc, tokens, start, ids in zip(*cols, strict=True):
            packer.put((doc, tokens), start, np.frombuffer(ids, "<u4"))
        done = [*packer.done, *packer.leftovers()]
        return pa.Table.from_batches([_batch(_piece_rows(done, base, False), table.schema.field("doc_id").type)])

    pieces = stored(source.mapInArrow(run, schema), "pieces")
    group = F.floor(F.shiftright("sequence_id", 32) / merge_partitions).alias("__group")
    merged = pieces.filter("__open").withColumn("__group", group).groupBy("__group").applyInArrow(merge, schema)
    return pieces.filter("NOT __open").unionByName(merged).drop("__open")


def _batch(rows: Iterator[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 9
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "__open"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
