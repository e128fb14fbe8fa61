"""One algorithm for episodes of every size.

An episode (or task, or source) may hold a third of all rows, so nothing here
sorts a whole episode in one task.  Rows belong to blocks that are functions of
their own values and of exact per-episode sums:

* ``depth_blocks``, ``time_blocks``: an episode of n rows is cut into ``ceil(n / size)`` stretches of
  nearly equal depth, where ``size`` is a ten-thousandth of all rows and at least
  ``BLOCK``.  An episode up to ``size`` is one block.  At most ``SHARE`` episodes can be
  longer than ``size`` and they have at most ``2 * SHARE`` blocks in all, so the
  tables of long episodes and of their blocks are safe to broadcast whatever the
  input.  The borders are quantiles of the rows' own order keys (time, then the
  columns that break ties), taken from the ``DEPTH`` rows a block whose keys hash
  lowest: uneven, equal, missing or outlying times make no block deep, and any run
  finds the same borders.
* ``number``: the 0-based position in the episode: rows of earlier blocks plus
  the row number inside the block.
* ``chunked``: windows whose frames reach a bounded number of rows run on chunks
  of ``BLOCK`` consecutive positions, with copies of the neighbouring rows as
  context.
* ``carried``: running lists: the list inside the chunk behind the lists of the
  chunks before.

No partition number enters a result.  ``depth_blocks`` runs one job, a count by
group that brings two numbers to the driver: where no group is long, which is the rule,
``_nb`` is a column of nulls without type, and every function here then plans the one
plain window that is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

BLOCK = 100_000
SHARE = 10_000
#: Keys looked at for each block: a block of twice its depth comes up once in 3e8.
DEPTH = 64


def time_blocks(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """``depth_blocks`` in the order of a timestamp, then ``ties``."""
    return depth_blocks(df, keys, [F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), *ties])


def depth_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Add ``_nb`` (number of blocks of a long group of ``keys``, else null) and
    ``_blk``, which rises with ``order`` (nulls first).  Rows that are equal in
    all of it lie in one block.  Without keys the whole table is the group."""
    if not keys:
        return depth_blocks(df.withColumn("_all", F.lit(0)), ["_all"], order).drop("_all")
    place = F.struct(*order)
    total, longest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
    size = max(BLOCK, (total or 0) // SHARE)
    if (longest or 0) <= size:
        return df.withColumn("_nb", F.lit(None)).withColumn("_blk", F.lit(0).cast("long"))
    looked = df.select(*keys, place.alias("_p")).withColumn("_p", F.when(F.pmod(F.xxhash64("_p"), F.lit(size)) < DEPTH, F.col("_p")))
    long = (looked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("_p")).alias("_s"))
            .where(F.col("_n") > size).withColumn("_nb", F.ceil(F.col("_n") / size)))
    # border i lies i / _nb of the way through the sorted keys; borders are kept in
    # ``_w`` runs of ``_w``, so a row is compared with two runs at most
    border = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_nb") - 1), lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_nb")).cast("int")))
    long = long.withColumn("_s", F.filter(border, lambda x: x.isNotNull())).withColumn("_w", F.ceil(F.sqrt(F.col("_nb"))).cast("int"))
    runs = F.when(F.size("_s") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / F.col("_w")).cast("int")),
                                                lambda i: F.slice("_s", i * F.col("_w") + 1, F.col("_w"))))
    # at most SHARE rows, which hold 2 * SHARE borders in all: each stands for more than a SHARE-th of the input
    j = df.withColumn("_p", place).join(F.broadcast(long.select(*keys, "_nb", "_w", runs.alias("_runs"))), list(keys), "left")
    passed = lambda run: F.size(F.filter(run, lambda x: x <= F.col("_p")))
    begun = F.size(F.filter("_runs", lambda run: F.get(run, F.lit(0)) <= F.col("_p")))
    inside = F.when(begun > 0, (begun - 1) * F.col("_w") + passed(F.get("_runs", begun - 1))).otherwise(F.lit(0))
    return j.withColumn("_blk", F.when(F.col("_runs").isNotNull(), inside).otherwise(F.lit(0)).cast("long")).drop("_p", "_w", "_runs")


def all_short(df: DataFrame) -> bool:
    """Whether ``_nb`` tells that no episode is long."""
    return "_nb" in df.columns and isinstance(df.schema["_nb"].dataType, NullType)


def number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the 0-based position ``name`` (long) of each row of ``time_blocks``."""
    if all_short(df):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (df.where(F.col("_nb").isNotNull()).groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_c"))
             .select(*keys, "_blk", F.sum("_c").over(before).alias("_ahead")))
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    # at most 2 * SHARE rows: the blocks of long episodes
    return (df.join(F.broadcast(ahead), [*keys, "_blk"], "left")
            .withColumn(name, F.coalesce("_ahead", F.lit(0)).cast("long") + F.row_number().over(inside) - 1).drop("_ahead"))


def chunk_of(df: DataFrame, index: str) -> Column:
    """Chunk of a position; where ``_nb`` tells long episodes, others are one chunk."""
    if all_short(df):
        return F.lit(0).cast("long")
    c = F.floor(F.col(index).cast("long") / BLOCK).cast("long")
    return F.when(F.col("_nb").isNotNull(), c).otherwise(F.lit(0).cast("long")) if "_nb" in df.columns else c


def renumber(df: DataFrame, keys: Sequence[str], index: str, name: str) -> DataFrame:
    """0-based position of the rows that a filter left, in the order of ``index``."""
    if all_short(df):
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1).cast("long"))
    d = df.withColumn("_c", chunk_of(df, index))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counted = d.where("_nb is not null") if "_nb" in df.columns else d
    ahead = counted.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_c", F.sum("_n").over(before).alias("_ahead"))
    inside = Window.partitionBy(*keys, "_c").orderBy(index)
    return (d.join(ahead, [*keys, "_c"], "left")
            .withColumn(name, F.coalesce("_ahead", F.lit(0)).cast("long") + F.row_number().over(inside) - 1).drop("_ahead", "_c"))


def chunked(df: DataFrame, keys: Sequence[str], index: str, before: int, after: int,
            fn: Callable[[DataFrame, Sequence[str]], DataFrame], keep: bool = False) -> DataFrame:
    """Run a row-preserving transform ``fn(df, keys)`` whose frames reach at most
    ``before`` rows back and ``after`` ahead (``index``: dense position).  Rows with
    ``_halo`` are context only.  ``keep`` leaves ``_chunk`` in the result."""
    if all_short(df):
        out = fn(df, list(keys))
        return out.withColumn("_chunk", F.lit(0).cast("long")) if keep else out
    i, c = F.col(index).cast("long"), chunk_of(df, index)
    kind = "array<struct<c:bigint,h:boolean>>"
    places = [F.array(F.struct(c.alias("c"), F.lit(False).alias("h")))]
    long = F.col("_nb").isNotNull() if "_nb" in df.columns else F.lit(True)

    def halo(first: Column, last: Column) -> Column:
        return F.when(long & (first <= last), F.transform(F.sequence(first, F.greatest(first, last)), lambda x: F.struct(x.alias("c"), F.lit(True).alias("h")))) \
            .otherwise(F.array().cast(kind))
    if before:
        places.append(halo(c + 1, F.floor((i + before) / BLOCK).cast("long")))
    if after:
        places.append(halo(F.greatest(F.floor((i - after) / BLOCK).cast("long"), F.lit(0).cast("long")), c - 1))
    x = df.withColumn("_p", F.explode(F.concat(*places))).withColumn("_chunk", F.col("_p.c")).withColumn("_halo", F.col("_p.h")).drop("_p")
    out = fn(x, [*keys, "_chunk"]).where(~F.col("_halo")).drop("_halo")
    return out if keep else out.drop("_chunk")


def carried(df: DataFrame, keys: Sequence[str], index: str, column: str) -> DataFrame:
    """``column`` is a running list inside each ``_chunk`` (of ``chunked`` with
    ``keep``); put the lists of the chunks before in front of it."""
    if all_short(df):
        return df
    counted = df.where("_nb is not null") if "_nb" in df.columns else df
    last = counted.groupBy(*keys, "_chunk").agg(F.max_by(column, index).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = last.select(*keys, "_chunk", F.flatten(F.collect_list("_l").over(before)).alias("_ahead"))
    return (df.join(ahead, [*keys, "_chunk"], "left")
            .withColumn(column, F.when(F.col("_ahead").isNull(), F.col(column)).otherwise(F.concat("_ahead", column))).drop("_ahead"))


def running_sum(df: DataFrame, keys: Sequence[str], index: str, value: str, name: str) -> DataFrame:
    """``name``: sum of ``value`` up to the row, itself included, over rows that hold the
    ``_chunk`` of ``chunked`` with ``keep``: the sum inside the chunk plus the chunks before."""
    if all_short(df):
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    known = "_nb" in df.columns
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ((df.where(F.col("_nb").isNotNull()) if known else df).groupBy(*keys, "_chunk").agg(F.sum(value).alias("_v"))
             .select(*keys, "_chunk", F.sum("_v").over(before).alias("_ahead")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    # where long episodes are known, their chunks are at most 2 * SHARE rows
    j = df.join(F.broadcast(ahead) if known else ahead, [*keys, "_chunk"], "left")
    return j.withColumn(name, F.coalesce("_ahead", F.lit(0)).cast("long") + F.sum(value).over(inside)).drop("_ahead")


def first_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows in a total ``order``, not merged in one task: rows of the
    blocks before the one that holds the n-th row are all in, only that block is
    ranked."""
    b = depth_blocks(df, [], order)
    if all_short(b):
        return df.orderBy(*order).limit(n)
    b = b.drop("_nb")
    counted = b.groupBy("_blk").agg(F.count(F.lit(1)).alias("_c"))          # at most SHARE + 1 rows
    upto = counted.select("_blk", "_c", F.sum("_c").over(Window.orderBy("_blk")).alias("_upto"))
    last = upto.where(F.col("_upto") - F.col("_c") < n).agg(F.max("_blk").alias("_last"), (n - F.max_by(F.col("_upto") - F.col("_c"), "_blk")).alias("_left"))
    b = b.crossJoin(F.broadcast(last))                                      # one row
    rank = F.row_number().over(Window.partitionBy("_blk").orderBy(*order))
    whole = b.where(F.col("_blk") < F.col("_last"))
    ranked = b.where(F.col("_blk") == F.col("_last")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).drop("_rank")
    return whole.unionByName(ranked).drop("_blk", "_last", "_left")
