"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text.  A text is parsed against it
into phrases, each the longest match from where the last ended; the fewer phrases a text needs, the closer it is to
the language.  Counts are normalised to bits a character, ``phrases * log2(sample length) / text length``, and the
language with the least bits wins.

Texts are cut into blocks of ``BLOCK`` characters that are parsed on their own (a phrase ends with its block), so that
numpy walks the automata of all languages over many blocks at once; every character of a text is parsed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.shared import slices, stored

BLOCK = 2048
#: Bound of the training sample: so many texts of each language, so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 160, 200
UNKNOWN = "und"
_SHIFT = 29  # a transition holds the state it leads to and, above these bits, the phrases that it ends
_PHRASE = np.int32(1 << _SHIFT)
_models: dict[tuple, Model] = {}


class Model(NamedTuple):
    langs: list[str]
    symbols: np.ndarray  # code point -> symbol; 0: not in any sample
    table: np.ndarray  # automata of all languages: state * width + symbol -> state, and phrases ended
    width: int
    roots: np.ndarray
    bits: np.ndarray  # log2 of each sample's length


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that reads every substring of ``text`` from state 0 (Blumer et al.)."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[q] != length[p] + 1:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        last = new
    return nxt


def build(samples: dict[str, str]) -> Model:
    """The model of ``samples`` (language -> text)."""
    langs = sorted(samples)
    chars = sorted(set("".join(samples.values())))
    symbols = np.zeros(0x110000, np.uint16)
    symbols[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    width = len(chars) + 1
    tables, roots, base = [], [], 0
    for lang in langs:
        states = suffix_automaton(samples[lang])
        root = np.full(width, base, np.int32) | _PHRASE  # a character the sample lacks is a phrase of its own
        for ch, to in states[0].items():
            root[symbols[ord(ch)]] = base + to
        # where a match ends, the phrase is counted and the character starts the next one at the root
        table = np.repeat((root + _PHRASE)[None, :], len(states), axis=0)
        for i, moves in enumerate(states):
            table[i, symbols[[ord(c) for c in moves]]] = [base + to for to in moves.values()]
        table[0] = root
        tables.append(table)
        roots.append(base)
        base += len(states)
    bits = np.log2([max(2, len(samples[lang])) for lang in langs]) if langs else np.zeros(0)
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
    return Model(langs, symbols, table, width, np.array(roots, np.int32), bits)


def phrases(model: Model, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of every text and language; ``codes``: the texts' code points in a row, ``sizes``: of each text."""
    out = np.zeros((len(sizes), len(model.langs)), np.int64)
    sym = model.symbols[codes]
    blocks = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), blocks)
    if not len(text):
        return out
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
    length = np.minimum(sizes[text] - nth * BLOCK, BLOCK)
    order = np.argsort(-length, kind="stable")
    start, text, length = start[order], text[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # blocks longer than each step
    state = np.repeat(model.roots[:, None], len(text), axis=1)
    count = np.zeros(state.shape, np.int32)
    for step, n in enumerate(live.tolist()):
        to = model.table[state[:, :n] * model.width + sym[start[:n] + step]]
        count[:, :n] += to >> _SHIFT
        state[:, :n] = to & (_PHRASE - 1)
    count += state != model.roots[:, None]  # a match that the block's end cut is a phrase too
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(text, weights=count[k], minlength=len(sizes)).astype(np.int64)
    return out


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS,
           chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Training text of each language: of the ``texts`` distinct texts with the smallest hash a passage of ``chars``.

    The passage's place follows from the hash too.  The size is bounded by the number of languages.
    """
    n = F.length(text)
    used = labelled.filter(F.col(lang).isNotNull() & (n > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("seed"), n.alias("n"), F.col(text).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("seed"))
    first = used.select("lang", "seed").distinct().withColumn("rank", rank).filter(F.col("rank") <= texts)
    first = stored(first, "sample")  # texts x languages rows
    place = F.pmod("seed", F.greatest(F.col("n") - chars + 1, F.lit(1))).cast("int") + 1
    part = F.lower(F.substring("text", place, F.lit(chars)))
    rows = used.join(F.broadcast(first), ["lang", "seed"]).groupBy("lang", "rank").agg(F.min(part).alias("part"))
    rows = rows.orderBy("lang", "rank").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["part"])
    return {k: " ".join(v) for k, v in out.items()}


def _model(samples: dict[str, str]) -> Model:
    """The automata are built once in each Python worker, from the sample that the closure carries."""
    key = tuple(sorted(samples.items()))
    if key not in _models:
        _models.clear()
        _models[key] = build(samples)
    return _models[key]


def identify(docs: DataFrame, samples: dict[str, str], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row of ``docs``.

    ``lang_pred`` is a language of ``samples``; ``und`` with score 0 if the text is null, has no letter, or there is no
    sample.  ``score`` is the winner's share of ``2 ** -bits`` over all languages (bits a character), between 0 and 1;
    ties go to the first language in order.  Whole texts are parsed whatever their length; rows may repeat.
    """
    source = docs.select(*keep, F.col(text).rlike(r"\p{L}").alias("__letter"), F.lower(text).alias("__text"))
    schema = source.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples)
        for whole in batches:
            for batch in slices(whole, "__text", 4 << 20):
                texts = [t if ok else "" for t, ok in zip(batch.column(len(keep) + 1).to_pylist(),
                                                          batch.column(len(keep)).to_pylist(), strict=True)]
                sizes = np.array([len(t) for t in texts], np.int64)
                codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model.langs:
                    bits = phrases(model, codes, sizes) * model.bits / np.maximum(sizes, 1)[:, None]
                    best = bits.argmin(axis=1)
                    share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                    scores = np.where(sizes > 0, 1 / share.sum(axis=1), 0.0)
                    langs = [model.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(langs, pa.string()), pa.array(scores)],
                                                 [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether a document is kept from training: crc32 of its id as text, modulo ``folds`` (a null id counts as '')."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds) == fold


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
            texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, predict all: ``doc_id, held_out, lang_pred, score``.

    Rows with a null ``lang`` or text teach nothing.  With no labelled row every text is ``und``.  An empty table gives
    an empty result.  Only the named columns are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"),
                       held_out(doc_id).alias("held_out"))
    samples = sample(rows.filter("NOT held_out"), "text", "lang", texts, chars)
    return identify(rows, samples, ("doc_id", "held_out"), "text")


