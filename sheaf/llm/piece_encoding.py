"""Exact encoding with a merge-type (BPE) SentencePiece model by backtracking, and decoding.

The merges of a text are never played through.  Its pieces are the one row of pieces in which every two neighbours are
*compatible*: merging the characters of both again gives these two pieces.  (Merges on both sides of a border that none
crosses do not know of each other, so a row is right if no border is crossed, and each border shows it alone.)

1. One Aho-Corasick pass over the reversed text gives the longest piece that starts at each place.
2. From the left, the longest piece that is compatible with the last one is taken; else its next shorter prefix that is
   a piece; if none is left, the place is marked as failed in a bitfield, the last piece is dropped, and a shorter one is
   tried in its stead.  A failed place is never entered again, so the work is linear in the text.
3. A character without a piece stands alone and is written as the pieces of its UTF-8 bytes.

Texts are first cut where no piece of the vocabulary can cross, before white space and around characters without a
piece; a distinct word is encoded once while the cache lasts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

from sheaf.llm.shared import binary_values, slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
BORDER = "\ue000"
_CACHE_WORDS = 200_000
_CACHE_PAIRS = 250_000
_CLOSING = ".,;:!?"
_JOINED_WORDS = 20_000
_SLICE_BYTES = 4 << 20
_SLICE_IDS = 1 << 20  # ids that are decoded at a time; a batch of Spark's has 10,000 rows, however long they are
_models: dict[str, Pieces] = {}


class Pieces:
    """The vocabulary of a merge-type model with byte fallback whose normaliser only marks spaces."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ a\t") != f"{SPACE}ﬁ{SPACE}a\t":
            raise ValueError(f"{path}: the model's normaliser does more than mark spaces")
        ids = range(model.get_piece_size())
        self.names = [model.id_to_piece(i) for i in ids]
        self.control = [model.is_control(i) for i in ids]
        self.bytes = {i: int(self.names[i][1:-1], 16) for i in ids if model.is_byte(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        if len(self.bytes) != 256 or self.end < 0:
            raise ValueError(f"{path}: byte fallback and an end piece are needed")
        self.byte_ids = [i for _, i in sorted((b, i) for i, b in self.bytes.items())]
        char = {i: chr(b) for i, b in self.bytes.items() if b < 0x80}
        self.surface = pa.array([char.get(i, "" if self.control[i] else self.names[i].replace(SPACE, " ")) for i in ids], pa.string())
        self.alone = np.array([i == self.unknown or self.bytes.get(i, 0) >= 0x80 for i in ids])  # not to be joined piece by piece
        self.silent, self.marked = np.array(self.control), np.array([n.startswith(SPACE) for n in self.names])
        plain = [i for i in ids if not (self.control[i] or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), None) for p in self.ids}
        self.backwards = ahocorasick.Automaton()
        for piece in self.ids:
            self.backwards.add_word(piece[::-1], piece)
        self.backwards.make_automaton()
        loose = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        part = "(?s:.+)" if crossing else f"{SPACE}*[^{SPACE}{loose}]+|{SPACE}+" + (f"|[{loose}]" if loose else "")
        self.parts = re.compile(part)
        behind = {b for p in self.ids for a, b in itertools.pairwise(p) if a.isalpha()}  # characters after a letter in some piece
        self.closing = "".join(c for c in _CLOSING if c not in behind)
        self.crossing = crossing or any(BORDER in p for p in self.ids)
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.choices: dict[tuple[str | None, str], str] = {}
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by its merges: the best pair first, the leftmost of equals."""
        symbols = list(text)
        while True:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(symbols)) if a + b in self.score]
            if not found:
                return symbols
            at = min(found)[1]
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, last: str | None, piece: str) -> bool:
        """Whether ``last`` and ``piece`` stay apart and whole when their characters are merged again."""
        known = self.pairs.get((last, piece))
        if known is None:
            if len(self.pairs) > _CACHE_PAIRS:
                self.pairs.clear()
            both = [piece] if last is None else [last, piece]
            known = self.pairs[last, piece] = self.merge("".join(both)) == both
        return known

    def longest(self, text: str) -> list[str]:
        """The longest piece that starts at each place; the character itself where none does."""
        out, last = list(text), len(text) - 1
        seen = -1
        for end, piece in self.backwards.iter(text[::-1]):  # matches of one end come longest first
            if end != seen:
                out[last - end] = piece
                seen = end
        return out

    def split(self, text: str) -> list[str]:
        """The pieces of a text, by backtracking."""
        longest, size = self.longest(text), len(text)
        open_ = bytearray(b"\1") * (size + 1)
        first = self.choices
        pieces: list[str] = []
        at, last, piece = 0, None, longest[0] if text else None
        while at < size:
            found = first.get((last, piece))
            if found is None:
                found = self._first(last, piece)
            while found and not open_[at + len(found)]:
                found = self.shorter.get(found)
                found = found and self._first(last, found)
            if found:
                pieces.append(found)
                at += len(found)
                last, piece = found, longest[at] if at < size else None
            elif last is None:
                raise ValueError(f"no row of pieces for {text!r}")
            else:
                open_[at] = 0
                piece = pieces.pop()
                at -= len(piece)
                last = pieces[-1] if pieces else None
        return pieces

    def _first(self, last: str | None, piece: str) -> str:
        """``piece`` or its longest shorter prefix that is compatible with ``last``; '' if none is."""
        if len(self.choices) > _CACHE_PAIRS:
            self.choices.clear()
        found = piece
        while found is not None and not self.compatible(last, found):
            found = self.shorter.get(found)
        self.choices[last, piece] = found or ""
        return found or ""

    def ids_of(self, pieces: list[str]) -> list[int]:
        """The ids of a row of pieces; a character without a piece is its UTF-8 bytes."""
        ids: list[int] = []
        known = self.ids.get
        for piece in pieces:
            found = known(piece)
            if found is not None:
                ids.append(found)
            else:
                ids += [self.byte_ids[b] for b in piece.encode()]
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without an end id."""
        return self._marked_ids(SPACE + text.replace(" ", SPACE)) if text else []

    def _marked_ids(self, marked: str) -> list[int]:
        return list(itertools.chain.from_iterable((self.ids_of(self.split(part)) for part in self.parts.findall(marked))))

    def _words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words behind a space mark each, and the count of each: one text with borders that nothing crosses."""
        self.ids[BORDER] = -1
        ids = np.array(self.ids_of(self.split(BORDER.join([SPACE + w for w in words]))), np.int32)
        del self.ids[BORDER]
        border = np.flatnonzero(ids < 0)
        return ids[ids >= 0], np.diff(np.concatenate([[-1], border, [len(ids)]])) - 1

    def _rows(self, atoms: list[str]) -> np.ndarray:
        """The cache's row of each of ``atoms`` (different words, or all tails behind a border), encoding those it lacks."""
        fresh = [w for w in atoms if w not in self.words]
        if fresh:
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
            if fresh[0].startswith(BORDER):
                tails = [self._marked_ids(w[1:]) for w in fresh]
                found = [(np.array(t, np.int32), [len(t)]) for t in tails]
            else:
                found = [self._words_ids(fresh[lo:lo + _JOINED_WORDS]) for lo in range(0, len(fresh), _JOINED_WORDS)]
            ids, sizes = [self.flat, *(f[0] for f in found)], [np.diff(self.starts), *(f[1] for f in found)]
            self.flat, self.starts = np.concatenate(ids), np.append(0, np.cumsum(np.concatenate(sizes)))
            self.uses = np.append(self.uses, np.zeros(len(fresh), np.int32))
        rows = np.fromiter(map(self.words.__getitem__, atoms), np.int64, len(atoms))
        self.uses[rows] += 1
        return rows

    def _atoms(self, words: pa.Array) -> np.ndarray:
        """The rows of the stem and the tail of each of ``words``; one that does not end in closing punctuation, or has no
        letter before it, is a stem with an empty tail."""
        trimmed = pc.utf8_rtrim(words, self.closing or " ")
        cut = pc.match_substring_regex(trimmed, r"\p{L}$")
        stems = pc.if_else(cut, trimmed, words).dictionary_encode()
        tails = pc.if_else(cut, pc.replace_substring_regex(words, f"^(?s:.)*?([{_CLOSING}]*)$", BORDER + r"\1"), BORDER).dictionary_encode()
        rows = [self._rows(x.dictionary.to_pylist())[x.indices.to_numpy()] for x in (stems, tails)]
        return np.stack(rows, axis=1)

    def _make_room(self) -> None:
        """Drop the words met in one slice only, else all, once there are too many."""
        if len(self.words) <= _CACHE_WORDS:
            return
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > _CACHE_WORDS // 2:
            self._forget()
            return
        names = list(self.words)
        size = np.diff(self.starts)[keep]
        self.flat = np.concatenate([self.flat[:0], *(self.flat[self.starts[i]:self.starts[i + 1]] for i in keep.tolist())])
        self.starts, self.uses = np.append(0, np.cumsum(size)), self.uses[keep] // 2 + 1
        self.words = dict(zip([names[i] for i in keep.tolist()], range(len(keep)), strict=True))

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without end ids.

        Where no piece crosses into white space, a text without runs of spaces is its words, each behind one space mark;
        where none joins a letter and closing punctuation, a word is its stem and its tail.  These are looked up as a whole.
        """
        whole = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        for mark in (SPACE, BORDER):
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        apart = whole.to_numpy(zero_copy_only=False) | self.crossing
        self._make_room()
        split = pc.split_pattern(texts.filter(pa.array(~apart)), " ")
        coded = split.flatten().dictionary_encode()
        atoms = self._atoms(coded.dictionary)[coded.indices.to_numpy()].ravel()
        size = np.diff(self.starts)[atoms]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[atoms] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.append(0, ends)[2 * (split.offsets.to_numpy() - split.offsets[0].as_py())]
        spaced = iter(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        out = []
        for one, text in zip(apart.tolist(), texts, strict=True):
            if one:
                out.append(np.array(self.encode(text.as_py()), np.int32))
            else:
                lo, hi = next(spaced)
                out.append(ids[lo:hi] if text.as_buffer().size else ids[:0])
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any row of ids: pieces with their spaces, runs of bytes as UTF-8 (a byte that is no part of a
        character becomes U+FFFD); control ids are silent, and the space put in front by ``encode`` goes."""
        out: list[str] = []
        first = True
        for is_byte, run in itertools.groupby(ids, self.bytes.__contains__):
            if is_byte:
                out.append(_characters(bytes(map(self.bytes.__getitem__, run))))
                first = False
                continue
            for i in run:
                if self.control[i]:
                    continue
                piece = " ⁇ " if i == self.unknown else self.names[i]
                out.append((piece.removeprefix(SPACE) if first else piece).replace(SPACE, " "))
                first = False
        return "".join(out)

    def decode_all(self, rows: pa.ListArray) -> pa.Array:
        """The text of each row of ids (null: empty); rows without bytes beyond ASCII are joined at once."""
        offsets = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        flat = rows.flatten().to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        hard = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=self.alone[flat], minlength=len(sizes)) > 0
        parts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.surface.take(pa.array(flat)))
        texts = pc.binary_join(parts, "")
        shown = ~self.silent[flat]
        first = np.append(np.flatnonzero(shown), len(flat))
        first = first[np.searchsorted(first, offsets[:-1])]  # the first piece that is not silent
        marked = (first < offsets[1:]) & np.append(self.marked[flat], False)[first]
        texts = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(texts, 1), texts)
        if hard.any():
            slow = [self.decode(flat[a:b].tolist()) for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), hard.tolist(), strict=True) if h]
            texts = pc.replace_with_mask(texts, pa.array(hard), pa.array(slow, pa.string()))
        return texts


def _valid(texts: pa.Array) -> pa.Array:
    """``texts`` without nulls and bytes that are no UTF-8."""
    filled = texts.fill_null("").cast(pa.string())
    try:
        filled.validate(full=True)
        return filled
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in binary_values(filled)], pa.string())


def _characters(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in range(1, 5):
            try:
                out.append(data[at:at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, text: str = "text", into: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` with ``into array<int>``: the ids of every whole text and one end id.

    A null or empty text is the end id alone; bytes that are no UTF-8 count as U+FFFD.  Every row is encoded by itself,
    so repeated rows, ties and an empty table need no rule; other columns pass through, ``into`` must not be among them.
    """
    if into in docs.columns:
        raise ValueError(f"the table has a column {into} already")
    path = model or public_tokenizers.path(MODEL)
    schema = StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for whole in batches:
            for batch in slices(whole, text, _SLICE_BYTES):
                ids, ends = [], [0]
                for got in own.encode_all(_valid(batch.column(batch.schema.get_field_index(text)))):
                    ids += [got, [own.end]]
                    ends.append(ends[-1] + len(got) + 1)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", into: str = "decoded", model: str | None = None) -> DataFrame:
    """``encoded`` with ``into string``: the text of each row's ids (null or none: empty).  Other columns pass through."""
    if into in encoded.columns:
        raise ValueError(f"the table has a column {into} already")
    path = model or public_tokenizers.path(MODEL)

    return encoded.mapInArrow(lambda batches: _decoded(batches, pieces(path), ids, into), StructType([*encoded.schema.fields, StructField(into, StringType())]))


def _decoded(batches: Iterator[pa.RecordBatch], own: Pieces, ids: str, into: str) -> Iterator[pa.RecordBatch]:
    """Batches with their texts, in parts of about ``_SLICE_IDS`` ids: decoding takes many times the bytes of its ids."""
    for whole in batches:
        at = whole.schema.get_field_index(ids)
        offsets = whole.column(at).offsets.to_numpy()
        cuts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // _SLICE_IDS)) + 1 if whole.num_rows else np.zeros(0, np.int64)
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), whole.num_rows]):
            batch = whole.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode_all(batch.column(at))], [*batch.schema.names, into])


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, through ``encode`` and ``decode``."""
    both = decode(encode(docs.select("doc_id", "text")).select("doc_id", "ids"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
