"""Helpers of the training-data operators: shared storage, row keys, Arrow batches, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may leave the setting out (tests); it then gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR, None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/{label}"


_temporary: list[list[str]] = []  # paths written inside of each open `temporary_tables`


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation upstream, several consumers read one execution,
    and Catalyst knows the table's true size when it picks a join.  The table stays until the caller's
    ``temporary_tables`` closes, else until the cluster clears the folder.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if _temporary:
        _temporary[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``stored``, in as many buckets of ``key`` as the session has shuffle partitions: joins by ``key`` leave the rows
    where they are."""
    spark = df.sparkSession
    path, name = new_path(spark, label), f"llm_{uuid.uuid4().hex}"
    if _temporary:
        _temporary[-1].append(path)
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(shuffle_partitions(spark), key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are in the shared folder, and the frame knows their buckets
    return table


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that are no longer reachable.

    It does so when the driver's JVM collects its garbage, on a large heap perhaps not before the end; between two phases,
    of which the first is ``stored``, this keeps both from lying on the disks together.
    """
    for _ in range(2):  # Python lets go of its frames in a thread of its own, so the first round may come too early
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, in whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what ``stored`` writes inside of this block at its end; results must have been written by then."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            drop_path(spark, path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted`` with as many underscores before it as no column of ``df`` needs, in any case, to start with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(wanted.lower()) for c in taken):
        wanted = f"_{wanted}"
    return wanted


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*cols: str) -> Column:
    """A 64-bit key of a row's identity and content; rows equal in both are interchangeable."""
    return F.xxhash64(*[F.col(c) for c in cols])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, text: str, each: int = 16 << 20) -> int:
    """Into how many buckets to deal what is made of the texts of ``df``, so that none grows with the corpus: one for every
    ``each`` bytes of text, and at least one a shuffle partition."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-size // each))


def binary_values(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string or binary Arrow column (null: None), without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass ``max_bytes``, so that one task's arrays stay small."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // max_bytes
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of lower-cased (A-Z) texts: a code for each in a row, the distinct words, and the count of each text.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D; a null text has none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    at = split.offsets.to_numpy() - split.offsets[0].as_py()
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes]
    counts = np.diff(np.append(0, np.cumsum(full))[at])
    return codes[full], coded.dictionary, counts


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal ``keys`` is cut; yields tables of whole runs.

    Rows must arrive sorted by ``keys``.  Memory: one batch and the longest run.
    """
    carry: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            values = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        cuts = np.flatnonzero(changed)
        first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
        if carry and first != last:
            yield pa.Table.from_batches(carry)
            carry = []
        if len(cuts):
            at = int(cuts[-1])
            yield pa.Table.from_batches([*carry, batch.slice(0, at)])
            carry = [batch.slice(at)]
        else:
            carry.append(batch)
        last = tuple(batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys)
    if carry:
        yield pa.Table.from_batches(carry)


def run_edges(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of rows equal in all ``columns``, and the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list ``(a, b)``: rows ``(node, component)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is one grouped minimum joined
    back on its key, each round is stored, and the number of rounds grows with the logarithm of the longest path.
    ``component`` is the smallest node of the component.
    """
    spark = edges.sparkSession
    now = stored(edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = stored(small.filter("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
