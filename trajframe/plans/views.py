"""Spark-side bindings of the driver tables to the operators' inputs
(FIXTURES.md §2).  Each function reads only the columns it needs, so the
parquet scans are pruned, and returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.blocks import chunked
from ..sources.tables import events_as_steps, table, task_description, task_dimension


def v_steps(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "props")
    return events_as_steps(ev)


def _numbered(spark: SparkSession, sf: str, position: bool) -> DataFrame:
    """F1 on the events: noise dropped, then ``step`` numbered in blocks; long
    episodes keep ``_nb`` (see ``operators.blocks``)."""
    ev = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "props")
    kept = events_as_steps(ev, position, order=True, only=W.not_noise(), number_as="step")
    return kept.drop("ts", "event_id", "_blk")


def with_tasks(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Attach task name / real id / description (30-row dimension, broadcast)."""
    dim = task_dimension(spark)
    out = df.join(F.broadcast(dim), "task_no", "left")
    return out.withColumn("task_desc", task_description(F.col("task_name")))


def v_f(spark: SparkSession, sf: str, position: bool = False) -> DataFrame:
    """F1 on v_steps with the dense ``step`` number (plus task columns)."""
    return with_tasks(_numbered(spark, sf, position), spark)


def v_f_plain(spark: SparkSession, sf: str, position: bool = False) -> DataFrame:
    return _numbered(spark, sf, position)


def v_eps(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct episodes with their position in corpus order within the task."""
    ev = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "props")
    return events_as_steps(ev, position=False).select("variation_id", "task_no", "fold").distinct()


def v_preds(spark: SparkSession, sf: str) -> DataFrame:
    f = v_f_plain(spark, sf)
    return f.select(
        "variation_id",
        F.floor(F.col("step") / 5).cast("long").alias("grp"),
        (F.col("step") % 5 + 1).cast("int").alias("rnk"),
        "action",
    )


def v_cands(spark: SparkSession, sf: str) -> DataFrame:
    p = v_preds(spark, sf)
    return (p.where(F.col("grp") >= 1)
            .select("variation_id", (F.col("grp") - 1).alias("grp"), "action").distinct())


def v_pairs(spark: SparkSession, sf: str) -> DataFrame:
    f = v_f_plain(spark, sf)
    nxt = chunked(f.select("task_no", "variation_id", "step", "action", "_nb"), ["variation_id"], "step", 0, 1,
                  lambda d, k: d.withColumn("target", F.lead("action").over(W.w_ep(k))))
    return nxt.where(F.col("target").isNotNull()).select("task_no", "variation_id", "step", F.col("action").alias("prediction"), "target")


def v_vecs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    return e.select(
        F.floor(F.col("vec_id") / 50).cast("long").alias("grp"),
        "vec_id", "embedding",
        (F.col("vec_id") % 50 < 5).alias("is_pred"),
    )


def over_chunks(spark: SparkSession, sf: str, op, before: int, after: int, episode=("task_no", "variation_id")) -> DataFrame:
    """Run a bounded-frame window operator ``op(steps, keys)`` over ``v_f`` in chunks."""
    return chunked(v_f_plain(spark, sf), list(episode), "step", before, after, op)
