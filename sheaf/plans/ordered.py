"""Skew-safe ordered scans: position, running sum and lag per key.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task.
When one root/user holds a third of all rows that task is the whole job.  Here
only such keys are treated apart, and no row is shuffled twice:

1. Rows are counted by a hash of the key into a fixed number of cells (a tiny
   shuffle).  A key can only be hot -- more than ``HOT_ROWS`` rows and more than
   a partition's share -- if its cell is; only rows of such cells are counted
   by key.  Without a hot key the scan is the plain window: one exchange.
2. A hot key's rows are cut into pieces by bounds from a sample of their order
   values; a piece holds about a partition's share.  The bounds are a stored
   table of at most two entries a partition, so the piece of a row is a function
   of the row, and a task that runs again gives the same pieces.
3. One exchange by ``(key, piece)``; windows inside of pieces.
4. The last row of each piece of a hot key (at most two rows a partition) gives
   the offsets of the next, broadcast back.

Results equal ``row_number()``, ``sum() ROWS UNBOUNDED PRECEDING`` and
``lag(1)`` over ``partitionBy(keys).orderBy(order)`` when the order is total.

:func:`pinned_order` lays rows out in ranges for the operators that walk them
(chains, history, rolling statistics): ``repartitionByRange`` spreads a
hot key in order, ``spark_partition_id`` and ``monotonically_increasing_id``
tell the place of a row, and a reliable ``checkpoint()`` into the session's
``spark.checkpoint.dir`` pins one execution, so a lost executor loses nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sheaf.session import ensure_checkpoint_dir, pinned_table

HOT_ROWS = 10_000  # no key with fewer rows is cut: that many narrow rows are no burden for a task
CELLS = 64  # for each partition
SAMPLES = 40  # for each piece


class Desc(NamedTuple):
    """A descending item of an order (nulls last)."""

    column: Column | str


def _column(item: Column | str | Desc) -> Column:
    c = item.column if isinstance(item, Desc) else item
    return F.col(c) if isinstance(c, str) else c


def _sorted(item: Column | str | Desc) -> Column:
    return _column(item).desc() if isinstance(item, Desc) else _column(item)


def pinned_order(df: DataFrame, keys: list[str], order: list, num_partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of ``(keys, order)``, with ``_pid`` and the consecutive ``_mid`` of each row.

    Reliable checkpoint in the cluster's shared checkpoint folder: one execution of the range exchange, lineage cut,
    executor-loss safe; all consumers read the same files.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [_sorted(o) for o in order]
    key_cols = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(n, *key_cols, *order_cols).sortWithinPartitions(*key_cols, *order_cols)
    ensure_checkpoint_dir(spark)
    return ranged.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")).checkpoint(eager=True)


def _hot_keys(df: DataFrame, keys: list[str], n: int, least: int) -> tuple[DataFrame | None, int]:
    """``keys`` and ``_n`` of the keys with more than a partition's share of rows (None: there are none), and that share."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS * n))
    cells = df.groupBy(cell.alias("_cell")).count().collect()  # at most CELLS a partition
    share = max(least, sum(c["count"] for c in cells) // n)
    full = [c["_cell"] for c in cells if c["count"] > share]  # fewer than n
    if not full:
        return None, share
    hot = df.filter(cell.isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > share)
    hot = pinned_table(hot, "hot_keys")
    return (hot if hot.limit(1).count() else None), share


def _bounds(df: DataFrame, keys: list[str], order: list, hot: DataFrame, share: int) -> DataFrame:
    """``keys`` and ``_bounds`` of the hot keys: order values that cut a key's rows into pieces of about ``share``."""
    rows = hot.agg(F.sum("_n"), F.sum(F.ceil(F.col("_n") / share))).first()
    value = F.struct(*[_column(o).alias(f"o{i}") for i, o in enumerate(order)])
    some = df.join(F.broadcast(hot), keys).select(*keys, "_n", value.alias("_o")).sample(min(1.0, SAMPLES * int(rows[1]) / int(rows[0])), seed=7)
    by_key = Window.partitionBy(*keys)
    place = by_key.orderBy(*[_sorted(Desc(F.col(f"_o.o{i}")) if isinstance(o, Desc) else F.col(f"_o.o{i}")) for i, o in enumerate(order)])
    some = some.select("*", F.row_number().over(place).alias("_r"), F.count(F.lit(1)).over(by_key).alias("_m"))
    pieces = F.ceil(F.col("_n") / share)
    cut = some.filter(F.floor(F.col("_r") * pieces / (F.col("_m") + 1)) > F.floor((F.col("_r") - 1) * pieces / (F.col("_m") + 1)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_o"))), lambda x: x["_o"])
    return pinned_table(cut.groupBy(*keys).agg(listed.alias("_bounds")), "bounds")


def _before(bound: Column, order: list) -> Column:
    """Whether a bound lies before the row, or is equal to it."""
    out = F.lit(True)
    for i, item in reversed(list(enumerate(order))):
        b, mine = bound[f"o{i}"], _column(item)
        less = (b > mine) | (b.isNotNull() & mine.isNull()) if isinstance(item, Desc) else (b < mine) | (b.isNull() & mine.isNotNull())
        out = F.coalesce(less, F.lit(False)) | (b.eqNullSafe(mine) & out)
    return out


def _pieces(df: DataFrame, keys: list[str], order: list, num_partitions: int | None = None) -> tuple[DataFrame, WindowSpec, bool]:
    """``df``, the window of a key or of a hot key's piece (``_piece``, -1 for other keys), and whether there are hot keys."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorts = [_sorted(o) for o in order]
    hot, share = _hot_keys(df, keys, n, 1 if num_partitions else HOT_ROWS)
    if hot is None:
        return df, Window.partitionBy(*keys).orderBy(*sorts), False
    bounds = _bounds(df, keys, order, hot, share)
    piece = F.when(F.col("_bounds").isNull(), -1).otherwise(F.size(F.filter("_bounds", lambda b: _before(b, order))))
    cut = df.join(F.broadcast(bounds), keys, "left").select(*df.columns, piece.alias("_piece"))  # at most two entries a partition
    return cut, Window.partitionBy(*keys, "_piece").orderBy(*sorts), True


def ordered_scan(df: DataFrame, keys: list[str], order: list, *, pos: str | None = None,
                 cumsum: dict[str, str] | None = None, lag: dict[str, str] | None = None,
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``pos`` (1-based row number), running sums and lags per ``keys`` in ``order``.

    ``order`` items are column names, ascending Columns or :class:`Desc` and must
    give a total order within a key; keys must be non-null.  ``cumsum``/``lag``
    map output column -> input column.  Pass a narrow frame (paths, not texts).
    With ``num_partitions`` keys are cut to shares of so many partitions, however
    small; else to the session's, and none of ``HOT_ROWS`` rows or fewer.
    """
    cumsum, lag = cumsum or {}, lag or {}
    if any(" NULLS FIRST" in str(o) or " NULLS LAST" in str(o) for o in order if isinstance(o, Column)):
        raise ValueError("give descending items of an order as Desc(column)")
    names = df.columns
    df, w, hot = _pieces(df, keys, order, num_partitions)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(w).cast("bigint")
    made = {name: F.sum(c).over(upto) for name, c in cumsum.items()} | {name: F.lag(c).over(w) for name, c in lag.items()}
    if not hot:
        return df.select(*names, *([at.alias(pos)] if pos else []), *[c.alias(name) for name, c in made.items()])
    scanned = df.select(*names, "_piece", at.alias("_at"), *[c.alias(f"_made_{name}") for name, c in made.items()],
                        F.lead(F.lit(1)).over(w).isNull().alias("_end"))
    ends = scanned.filter((F.col("_piece") >= 0) & F.col("_end"))
    of_key = Window.partitionBy(*keys).orderBy("_piece")
    earlier = of_key.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*keys, "_piece", F.coalesce(F.sum("_at").over(earlier), F.lit(0)).alias("_off"),
                          *[F.sum(f"_made_{name}").over(earlier).alias(f"_off_{name}") for name in cumsum],
                          *[F.lag(c).over(of_key).alias(f"_carry_{name}") for name, c in lag.items()])
    out = scanned.join(F.broadcast(offsets), [*keys, "_piece"], "left")  # at most two rows a partition
    cols = [F.col(c) for c in names]
    if pos:
        cols.append((F.col("_at") + F.coalesce("_off", F.lit(0))).cast("bigint").alias(pos))
    for name in cumsum:
        cols.append(F.when(F.col(f"_off_{name}").isNull(), F.col(f"_made_{name}"))
                    .otherwise(F.coalesce(F.col(f"_made_{name}"), F.lit(0)) + F.col(f"_off_{name}")).alias(name))
    for name in lag:
        cols.append(F.when(F.col("_at") == 1, F.col(f"_carry_{name}")).otherwise(F.col(f"_made_{name}")).alias(name))
    return out.select(*cols)


def islands(df: DataFrame, keys: list[str], order: list, value: str, gap: int, name: str) -> DataFrame:
    """Add ``name``: the island of each row per ``keys`` in ``order``, from 1; a step of ``gap`` or more in ``value``
    starts a new one.

    One exchange: steps are counted inside of keys, or of a hot key's pieces; the step over each border comes from the
    pieces' first and last values.  ``value`` is non-null and does not decrease in ``order``.
    """
    names = df.columns
    df, w, hot = _pieces(df, keys, order)
    step = F.coalesce((F.col(value) - F.lag(value).over(w) >= gap).cast("bigint"), F.lit(0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = df.select(*df.columns, step.alias("_new"), *([F.row_number().over(w).alias("_at"), F.lead(F.lit(1)).over(w).isNull().alias("_end")] if hot else []))
    run = run.withColumn("_run", F.sum("_new").over(upto))
    if not hot:
        return run.select(*names, (F.col("_run") + 1).alias(name))
    ends = run.filter((F.col("_piece") >= 0) & (F.col("_end") | (F.col("_at") == 1))).groupBy(*keys, "_piece").agg(
        F.max("_run").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    of_key = Window.partitionBy(*keys).orderBy("_piece")
    border = F.coalesce((F.col("_lo") - F.lag("_hi").over(of_key) >= gap).cast("bigint"), F.lit(0))
    before = F.coalesce(F.sum("_n").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select(*keys, "_piece", border.alias("_border"), before.alias("_before")).withColumn(
        "_off", F.sum("_border").over(of_key.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before"))
    out = run.join(F.broadcast(offsets.select(*keys, "_piece", "_off")), [*keys, "_piece"], "left")  # two rows a partition
    return out.select(*names, (F.coalesce("_off", F.lit(0)) + F.col("_run") + 1).alias(name))


def exact_long(col: Column | str) -> Column:
    """Running sums as BIGINT (they keep the input type; DOUBLE inputs are rounded)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c).cast("bigint")

