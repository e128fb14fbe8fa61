"""Sinks (K1-K6).  All are DataFrame writers; no rows pass through the
driver.  Output folders live under the shared folder named by
``spark.checkpoint.dir`` (``scratch_dir``), never a machine-local temp dir.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/trajframe-out/{name}-{uuid.uuid4().hex[:12]}"


#: What orders examples: of an episode by step, of a task by episode.
EXAMPLE_ORDER = ("task_id", "variation_id", "step")


def _dealt(df: DataFrame, folders: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt by range, so that a large folder is split over tasks, small ones share
    one, and in a folder the files' numbers, then their lines, follow ``order``."""
    by = [*folders, *(c for c in order if c in df.columns)]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def write_examples(df: DataFrame, path: str, split: str = "fold", task: str = "task_real_id",
                   order: Sequence[str] = EXAMPLE_ORDER) -> None:
    """K1: examples per split and per task (``split=<s>/task_real_id=<t>/``), in order;
    ``step`` only orders, it is not written."""
    _dealt(df, (split, task), order).drop("step").write.mode("overwrite").partitionBy(split, task).json(path)


def write_groups(df: DataFrame, path: str, group: str = "task_group", split: str = "fold",
                 mini_split: str = "dev", mini_n: int = 2000, order: Sequence[str] = EXAMPLE_ORDER) -> None:
    """K2: examples per task group per split, in order, plus the first ``mini_n`` rows
    of each group's validation split as split ``<mini_split>.mini``.  ``order`` must
    be total inside a group, which holds several tasks."""
    w = Window.partitionBy(group).orderBy(*order)
    mini = (df.where(F.col(split) == mini_split).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= mini_n).drop("_rn").withColumn(split, F.lit(f"{mini_split}.mini")))
    _dealt(df.unionByName(mini), (group, split), order).write.mode("overwrite").partitionBy(group, split).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_annotations(spark: SparkSession, df: DataFrame, path: str,
                       keys: Sequence[str] = ("task_no", "variation_id", "model")) -> None:
    """K3: append annotated episodes to the Parquet cache, idempotently: rows
    whose (task, variation, model) is already stored are skipped, and of several
    rows of one key one is written."""
    new = df.dropDuplicates(list(keys))
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    new.write.mode("append").parquet(path)


def write_metrics(df: DataFrame, path: str, run_id: str) -> None:
    """K4: append metric rows keyed by ``run_id``."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_predictions(df: DataFrame, path: str, col: str = "prediction", order: Sequence[str] = EXAMPLE_ORDER) -> None:
    """K5: predictions, stripped, one per line: line i, over the files by name, is the
    prediction of example i in ``order``.  A line end inside a prediction reads as a
    blank, so that the lines stay aligned; null is an empty line."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"^\s+|\s+$", ""), r"\r\n|\r|\n", " ")
    df.select(*order, text.alias("value")).orderBy(*order).select("value").write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of text files with their place: ``line`` (0-based over the files
    by name) and ``value``.  Lines are placed in their file as it is read; a table of
    one row a file says how many lie before it."""
    files = spark.read.text(path, wholetext=False).select(F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                                                          F.monotonically_increasing_id().alias("_i"), "value")
    inside = F.row_number().over(Window.partitionBy("_f", "_s").orderBy("_i")) - 1
    sizes = files.groupBy("_f", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(sizes.select("_f", "_s", before.alias("_b")), ["_f", "_s"]).select((F.col("_b") + inside).alias("line"), "value")


def write_history(df: DataFrame, path: str, max_rows: int) -> None:
    """K6: per-episode run history appended as Parquet, at most ``max_rows``
    rows per file."""
    df.write.mode("append").option("maxRecordsPerFile", max_rows).parquet(path)


def rename_parts(spark: SparkSession, src: str, dst_dir: str, name_of) -> None:
    """Give Spark's part files reference-style names (``<task>-<n>.<split>.json``)
    with Hadoop file-system renames (metadata only; no data moves through
    the driver).  ``name_of(partition_values: dict, n: int) -> file name``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(src).getFileSystem(conf)
    fs.mkdirs(Path(dst_dir))
    it = fs.listFiles(Path(src), True)
    found = []
    while it.hasNext():
        p = it.next().getPath()
        if p.getName().startswith("part-"):
            found.append(p)
    for n, p in enumerate(found):  # list first, rename after: the listing is not modified while read
        parts = {}
        q = p.getParent()
        while q is not None and "=" in q.getName():
            k, v = q.getName().split("=", 1)
            parts[k] = v
            q = q.getParent()
        target = Path(f"{dst_dir}/{name_of(parts, n)}")
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"cannot rename {p} to {target}")
