"""Reports without a second pass: what an operator could not use is counted by metrics
of the running query (``Observation``) and kept in a side table of the same write.

The faults of an operator are named conditions on its rows; a row has the first that
holds.  ``watched`` only counts; ``write_checked`` writes the rows once, partitioned
by their fault, so the good rows and the rejected ones are two folders of one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

NONE = "none"


def fault_of(faults: dict[str, Column]) -> Column:
    """Name of the first fault that holds, else ``none``."""
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in faults.items()]
    return F.coalesce(*names, F.lit(NONE))


def watched(df: DataFrame, name: str, faults: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and its counts (``rows`` and one for each fault), which are there
    once an action has run over it: ``observation.get``."""
    seen = Observation(name)
    which = fault_of(faults)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(which == k).alias(k) for k in faults]), seen


def write_checked(df: DataFrame, path: str, name: str, faults: dict[str, Column]) -> dict[str, int]:
    """Write ``df`` as Parquet with a column ``fault``, in one pass; the counts."""
    rows, seen = watched(df, name, faults)
    rows.withColumn("fault", fault_of(faults)).write.mode("overwrite").partitionBy("fault").parquet(path)
    return dict(seen.get)


def accepted_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows without fault of ``write_checked``."""
    return spark.read.parquet(path).where(F.col("fault") == NONE).drop("fault")


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """Its side table: the other rows and their ``fault``."""
    return spark.read.parquet(path).where(F.col("fault") != NONE)


def task_faults() -> dict[str, Column]:
    """Rows whose task the dimension lacks."""
    return {"unknown task": F.col("task_name").isNull()}


def answer_faults(answer: str = "answer") -> dict[str, Column]:
    """L1: answers that are empty, or hold no parseable item."""
    from .annotate import ITEM_RE
    items = F.regexp_extract_all(F.col(answer), F.lit(ITEM_RE), F.lit(0))
    return {"no answer": F.coalesce(F.length(answer), F.lit(0)) == 0, "no item": F.size(items) == 0}


def label_faults(action: str = "action", annotated: str = "annotated") -> dict[str, Column]:
    """Steps past the end of their annotation, or annotated with another action."""
    return {"no annotation": F.col(annotated).isNull(), "another action": F.col(annotated) != F.col(action)}


def labelled_with_action(steps: DataFrame, ann: DataFrame, keys: Sequence[str], order: str = "step", ann_order: str = "idx") -> DataFrame:
    """L6's labelled steps with the ``annotated`` action beside the step's own."""
    a = ann.select(*keys, F.col(ann_order).alias(order), F.col("action").alias("annotated"), F.col("sg").alias("subgoal"))
    return steps.drop("subgoal").join(a, [*keys, order], "left")


def too_few(seen: Observation, n: int) -> bool:
    """T5: whether fewer than the ``n`` rows asked for were there."""
    return seen.get["rows"] < n


def summary(spark: SparkSession, counts: dict[str, dict[str, int]]) -> DataFrame:
    """``report, fault, n`` of several reports' counts."""
    rows = [(r, k, int(n)) for r, c in counts.items() for k, n in c.items()]
    return spark.createDataFrame(rows, "report string, fault string, n long")
