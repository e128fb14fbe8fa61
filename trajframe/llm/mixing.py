"""Operator 10, mixing sources to target weights by a low-discrepancy schedule.

Only DataFrame functions.  ``targets`` shares the mix among the sources by
weight and stops each at ``CAP`` times its size.  The mix is a row of slots of
``block`` words each; slot i falls at the golden-ratio point ``frac((i + 1/2) *
phi)`` of the cumulated targets and so belongs to one source, evenly spread in
every stretch of the schedule.  Slots are ranked per source.  The documents of a
source, shuffled by a hash, form a stream of words, twice over, cut into blocks
of equal words; block j is joined to the source's slot of rank j, and a document
gives the words its blocks hold in joined slots; the slot of its first taken word
is its place in the mix.  The number of slots fits a target only to a block or so;
the rest of the target is then taken from a last block in part, at the end of the
schedule (or the last blocks are given back), so every source gives its target to
the word, however small it is beside a block.

Slots meet sources by an equi-join on grid cells.  Running sums and ranks are
taken in two levels (chunks, then inside a chunk), so a source with a third of
all rows is never one sort.

Defined cases: a null text has size 0 and gives nothing; a null source is a
source of its own, last in order; without words all targets are 0; repeated rows
are documents of their own; the order depends on ``doc_id`` (null as empty), size
and nothing else, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Words in a block at most, and the least number of slots when a block has more than one word.
BLOCK, SLOTS = 8192, 131072
PHI = 0.6180339887498949
GRID, CHUNK = 4096, 4096


def words(column: str) -> F.Column:
    """Number of words of a text (null: 0)."""
    trimmed = F.regexp_replace(F.col(column), r"^[\x20\x09-\x0D]+", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, SPACE)) - F.when(trimmed.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """``rank, source, source_size, target, lower, upper`` of every source; the
    targets lie end to end on [0, 1) as ``lower`` to ``upper``."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1))
    ranked = (ranked.withColumn("total", F.lit(SHARE) * F.sum("source_size").over(whole)).withColumn("cap", F.col("source_size") * CAP)
              .withColumn("fill", F.col("cap") / F.col("weight")))
    # sources fill up in this order; the first that the level doesn't fill sets the level
    filled = Window.orderBy("fill", "rank")
    level = ((F.col("total") - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", level)
    top = F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(whole)
    shared = ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(top, F.lit(0.0)) * F.col("weight")))
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shared = shared.withColumn("_end", F.sum("target").over(run))
    return shared.select("rank", "source", "source_size", "target", "total",
                         F.when(F.col("total") > 0, (F.col("_end") - F.col("target")) / F.col("total")).otherwise(0.0).alias("lower"),
                         F.when(F.col("total") > 0, F.col("_end") / F.col("total")).otherwise(0.0).alias("upper"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """``slot, rank, block``: the source of every slot and which of its blocks lies there."""
    spark = sources.sparkSession
    point = (F.col("id") + 0.5) * PHI
    row = spark.range(0, slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", F.floor(F.col("u") * GRID))
    held = sources.where("upper > lower").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * GRID), F.floor(F.col("upper") * GRID))))
    owned = (row.join(held.select("cell", "rank", "lower", "upper"), "cell").where("u >= lower and u < upper")
             .select("slot", "rank", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    before = (owned.groupBy("rank", "chunk").count()
              .withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (owned.join(before.select("rank", "chunk", "before"), ["rank", "chunk"])
            .select("slot", "rank", (F.col("before") + F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1).alias("block")))


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with words and its ``offset`` in its source's shuffled stream."""
    ranked = sized.join(sources.select(F.col("source").alias("_s"), "rank", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ranked = ranked.withColumn("part", F.substring("key", 1, 3))
    before = (ranked.groupBy("rank", "part").agg(F.sum("size").alias("_n"))
              .withColumn("before", F.coalesce(F.sum("_n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    inside = Window.partitionBy("rank", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (ranked.join(before.select("rank", "part", "before"), ["rank", "part"])
            .withColumn("offset", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("part", "before", "key"))


def pieces(streamed: DataFrame, block: int) -> DataFrame:
    """``rank, offset, epoch, block, start, end``: the words of each document in each block of its source's doubled stream."""
    twice = streamed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(CAP - 1))))
    at = twice.withColumn("_from", F.col("epoch") * F.col("source_size") + F.col("offset")).withColumn("_to", F.col("_from") + F.col("size"))
    cutup = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    start = F.greatest(F.col("_from"), F.col("block") * block) - F.col("block") * block
    end = F.least(F.col("_to"), (F.col("block") + 1) * block) - F.col("block") * block
    return cutup.select("rank", "offset", "epoch", "block", start.alias("start"), end.alias("end"))


def fitted(slots: DataFrame, sources: DataFrame, block: int, n: int) -> DataFrame:
    """``rank, block, held, slot``: the blocks that a source gives, the words of each
    that count and where they lie in the schedule of ``n`` slots.  Blocks that the target
    needs past the scheduled ones follow at its end, the first of every source,
    then the second."""
    scheduled = slots.groupBy("rank").agg(F.count(F.lit(1)).alias("slots"))
    wanted = (sources.select("rank", F.round("target").cast("long").alias("want")).where("want > 0").join(scheduled, "rank", "left")
              .withColumn("slots", F.coalesce("slots", F.lit(0).cast("long"))).withColumn("blocks", F.ceil(F.col("want") / block)))
    many = sources.agg(F.count(F.lit(1))).scalar()
    past = wanted.where("blocks > slots").withColumn("block", F.explode(F.sequence(F.col("slots"), F.col("blocks") - 1)))
    past = past.withColumn("slot", n + (F.col("block") - F.col("slots")) * many + F.col("rank") - 1)
    within = slots.join(wanted.select("rank", "want"), "rank")
    return within.select("rank", "block", "want", "slot").unionByName(past.select("rank", "block", "want", "slot")).select(
        "rank", "block", F.greatest(F.lit(0), F.least(F.lit(block), F.col("want") - F.col("block") * block)).alias("held"), "slot")


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, first_slot`` (the
    slot of its first taken word, null if none is) and the columns to ``keep``."""
    sized = cut(docs.select("doc_id", "source", words("text").alias("size"), *keep,
                            F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix"))).alias("key")), "sizes")
    sources = cut(targets(sized), "sources")
    total = sources.agg(F.max("total")).first()[0] or 0.0
    block = max(1, min(BLOCK, int(total / SLOTS)))
    n = -int(-total // block)
    streamed = cut(streams(sized, sources), "streams")
    given = fitted(schedule(sources, n), sources, block, n)
    length = F.greatest(F.lit(0), F.least("end", "held") - F.col("start"))
    taken = (pieces(streamed, block).join(given, ["rank", "block"])
             .groupBy("rank", "offset").agg(F.sum(length).alias("taken"), F.min(F.when(length > 0, F.col("slot"))).alias("first_slot")).withColumn("words", F.lit(True)))
    return (streamed.withColumn("words", F.col("size") > 0).join(taken, ["rank", "offset", "words"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.col("first_slot").cast("long").alias("first_slot"), *keep))


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':mix') as key from documents),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as rank from d group by source),
s1 as (select *, [3, 1, 2][(rank - 1) % 3 + 1] as weight, 1.5::double * sum(source_size) over () as total, 2 * source_size as cap from s0),
s2 as (select *, (total - coalesce(sum(cap) over (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by cap::double / weight, rank rows between current row and unbounded following) as level from s1),
s3 as (select *, least(cap::double, coalesce(max(level) filter (where level <= cap::double / weight) over (), 0) * weight) as target from s2),
s4 as (select *, sum(target) over (order by rank rows between unbounded preceding and current row) as e from s3),
b as (select max(total) as total, greatest(1, least(8192, floor(max(total) / 131072)))::bigint as block from s4),
u as (select i, (i + 0.5::double) * 0.6180339887498949::double - floor((i + 0.5::double) * 0.6180339887498949::double) as u
      from b, unnest(range(ceil(b.total / b.block)::bigint)) t(i)),
slot as (select rank, i as slot, row_number() over (partition by rank order by i) - 1 as block
         from u join s4 on s4.total > 0 and u.u >= (s4.e - s4.target) / s4.total and u.u < s4.e / s4.total),
n as (select s4.rank, count(slot.rank) as slots, any_value(round(s4.target))::bigint as want from s4 left join slot on slot.rank = s4.rank group by s4.rank),
o as (select d.*, s4.rank, s4.source_size, s4.target,
             coalesce(sum(size) over (partition by s4.rank order by key, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as off
      from d join s4 on d.source is not distinct from s4.source)
select doc_id, size, source_size, target,
       (greatest(0, least(off + size, want) - off) + greatest(0, least(source_size + off + size, want) - (source_size + off)))::bigint as taken,
       case when size > 0 and off < want then
         coalesce(slot.slot, ceil(b.total / b.block)::bigint + (off // b.block - slots) * (select count(*) from s4) + o.rank - 1) end::bigint as first_slot
from o join n on n.rank = o.rank cross join b left join slot on slot.rank = o.rank and slot.block = off // b.block
"""
