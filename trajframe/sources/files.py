"""File sources.

Everything is a ``spark.read`` with an explicit schema; nothing is parsed on
the driver.  The gold corpus format is one JSON object (task id -> task); a
directory of such objects (one per file, or one per line) is read in
parallel and should be re-sharded to Parquet once (``reshard``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

STEP_STRUCT = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("observation", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("isCompleted", T.StringType()),
    T.StructField("freelook", T.StringType()), T.StructField("inventory", T.StringType()),
])
EPISODE_STRUCT = T.StructType([
    T.StructField("taskDescription", T.StringType()), T.StructField("variationIdx", T.LongType()),
    T.StructField("fold", T.StringType()), T.StructField("path", T.ArrayType(STEP_STRUCT)),
])
TASK_STRUCT = T.StructType([
    T.StructField("taskName", T.StringType()), T.StructField("taskIdx", T.StringType()),
    T.StructField("goldActionSequences", T.ArrayType(EPISODE_STRUCT)),
])
GOLD_SCHEMA = T.MapType(T.StringType(), TASK_STRUCT)

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("input", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("task_id", T.IntegerType()), T.StructField("variation_id", T.LongType()),
    T.StructField("task_real_id", T.StringType()),
])

MESSAGE_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
])


def read_gold(spark: SparkSession, path: str, one_object_per_file: bool = True) -> DataFrame:
    """Gold corpus -> one row per step.

    Each file holds one JSON object ``{task_id: {taskName, taskIdx,
    goldActionSequences: [...]}}``; ``wholetext`` keeps a multi-line object in
    one record (``one_object_per_file=False`` reads one object per line, the
    splittable form for large corpora).  Output: task_id, task_name, task_idx, variation_id,
    task_desc, fold, episode_pos (corpus order), pos, step fields, and
    ``score`` cast to double (it may arrive as text).  A malformed object fails
    the job; ``source_file`` and, inside it, ``task_pos`` and ``episode_pos`` give
    the corpus order."""
    raw = spark.read.text(path, wholetext=one_object_per_file)
    objects = F.from_json("value", GOLD_SCHEMA, {"mode": "FAILFAST"})
    tasks = (raw.where(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_name").alias("source_file"), objects.alias("o"))
             .select("source_file", F.posexplode(F.map_entries("o")).alias("task_pos", "_e"))
             .select("source_file", "task_pos", F.col("_e.key").alias("task_id"), F.col("_e.value").alias("t")))
    eps = tasks.select("source_file", "task_pos", "task_id", F.col("t.taskName").alias("task_name"), F.col("t.taskIdx").alias("task_idx"),
                       F.posexplode("t.goldActionSequences").alias("episode_pos", "e"))
    return _gold_steps(eps.select("source_file", "task_pos", "task_id", "task_name", "task_idx", "episode_pos", "e", F.posexplode("e.path").alias("pos", "s")))


#: What opens every episode of the format; inside a JSON string its quotes would be escaped.
EPISODE_TOKEN = '"taskDescription"'
SEQUENCES_TOKEN = '"goldActionSequences"'
#: What may follow the last ``]`` before the next episode, or the end of the object.
SAME_TASK = r"(?s)^\s*\}\s*,\s*\{\s*$"
NEXT_TASK = r'(?s)"((?:[^"\\]|\\.)*)"\s*:\s*\{([^{}]*)"goldActionSequences"\s*:\s*\[\s*\{\s*$'
END = r"(?s)^\s*(\{\s*\}|\}\s*\})\s*$"


def read_gold_ranges(spark: SparkSession, path: str) -> DataFrame:
    """S1 for objects of any size: the rows of ``read_gold``, but one object is read by
    many tasks, a byte range each.

    The text is split at the token that opens an episode, which Spark does range by
    range; a record then holds one episode and, behind its last ``]``, what opens
    the next one or the next task.  A running count of tasks (inside each range, plus
    the ranges before) tells every episode its task, and the task its name.  An
    episode must begin with its ``taskDescription`` and a task end with its
    sequences, as the format writes them; anything else, like a malformed object or
    one that breaks off, fails the job (``read_gold`` reads objects in other orders)."""
    raw = (spark.read.option("lineSep", EPISODE_TOKEN).text(path)
           .select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_id"), "value"))
    raw = cut(raw, "gold-records").withColumn(
        "_opens", ((F.length("value") - F.length(F.replace("value", F.lit(SEQUENCES_TOKEN), F.lit("")))) / len(SEQUENCES_TOKEN)).cast("long"))
    # one row a range, prefix-summed over the file
    ranges = raw.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum("_opens").alias("_o"))
    before = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                           F.coalesce(F.sum("_o").over(before), F.lit(0)).alias("_o0"), F.sum("_n").over(Window.partitionBy("source_file")).alias("_all"))
    inside = Window.partitionBy("source_file", "_block").orderBy("_id")
    rec = (raw.join(ranges, ["source_file", "_block"])
           .withColumn("_at", F.col("_n0") + F.row_number().over(inside) - 1)
           .withColumn("_upto", F.col("_o0") + F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("_tail", F.substring_index("value", "]", -1)))
    ends = F.col("_at") == F.col("_all") - 1
    whole = F.when(ends, F.col("_tail").rlike(END)).otherwise(F.col("_tail").rlike(SAME_TASK) | F.col("_tail").rlike(NEXT_TASK))
    checked = F.when(whole, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed corpus object in "), F.col("source_file"))))
    rec = cut(rec.select("source_file", "_at", "_upto", "_opens", "_tail", checked.alias("value")), "gold-episodes")

    # null, not malformed, where a record opens no task: Spark may parse before it filters
    opens = F.col("_tail").rlike(NEXT_TASK)
    fields = F.concat(F.lit("{"), F.regexp_extract("_tail", NEXT_TASK, 2), F.lit('"goldActionSequences": []}'))
    name = F.from_json(F.when(opens, F.concat(F.lit('{"k": "'), F.regexp_extract("_tail", NEXT_TASK, 1), F.lit('"}'))), "k string", {"mode": "FAILFAST"})
    tasks = (rec.where(opens)
             .select("source_file", (F.col("_upto") - 1).cast("int").alias("task_pos"), F.col("_at").alias("_head"), name["k"].alias("task_id"),
                     F.from_json(F.when(opens, fields), TASK_STRUCT, {"mode": "FAILFAST"}).alias("t")))
    eps = rec.where("_at > 0").select("source_file", "_at", (F.col("_upto") - F.col("_opens") - 1).cast("int").alias("task_pos"),
                                      F.from_json(F.when(F.col("_at") > 0, F.concat(F.lit("{" + EPISODE_TOKEN), "value")), EPISODE_STRUCT, {"mode": "FAILFAST"}).alias("e"))
    eps = eps.join(tasks, ["source_file", "task_pos"])
    steps = eps.select("source_file", "task_pos", "task_id", F.col("t.taskName").alias("task_name"), F.col("t.taskIdx").alias("task_idx"),
                       (F.col("_at") - F.col("_head") - 1).cast("int").alias("episode_pos"), "e", F.posexplode("e.path").alias("pos", "s"))
    return _gold_steps(steps)


def _gold_steps(steps: DataFrame) -> DataFrame:
    return steps.select("source_file", "task_pos", "task_id", "task_name", "task_idx", "episode_pos", F.col("e.variationIdx").alias("variation_id"),
                        F.col("e.taskDescription").alias("task_desc"), F.col("e.fold").alias("fold"),
                        F.col("pos").cast("int").alias("pos"), "s.action", "s.observation",
                        F.col("s.score").try_cast("double").alias("score"),
                        F.col("s.isCompleted").alias("isCompleted"), "s.freelook", "s.inventory")


def reshard(df: DataFrame, path: str, partition_by: Sequence[str] = ("task_id",)) -> None:
    """Write a parsed corpus once as Parquet partitioned by task, so later
    jobs prune to the tasks they need."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_examples(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = EXAMPLE_SCHEMA) -> DataFrame:
    """Example JSONL with a fixed schema; malformed rows fail the job
    (``FAILFAST``) and a missing path is an error (Spark raises on it)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))


def read_split(spark: SparkSession, directory: str, split: str, schema: T.StructType = EXAMPLE_SCHEMA) -> DataFrame:
    """S3: the example files of ``<directory>/<split>``.  ``val`` takes ``*.val.json``
    only (not ``*.val.mini.json``), train and test take every ``.json``.  Adds
    ``source_file`` (from the file metadata)."""
    pattern = "*.val.json" if split == "val" else "*.json"
    df = (spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern)
          .json(f"{directory}/{split}"))
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def read_annotations(spark: SparkSession, path: str, legacy_csv: bool = False) -> DataFrame:
    """Annotation cache.  Parquet by default; the legacy CSV form
    (latin-1, multi-line cells, header) stores the nested columns as Python
    literals, which parse as JSON with single quotes allowed.
    Output: variations, chatgpt_output, subgoal array, path_act_sg array
    (``idx`` null for inserted ``*`` rows)."""
    if not legacy_csv:
        return spark.read.parquet(path)
    raw = (spark.read.option("header", "true").option("multiLine", "true").option("encoding", "ISO-8859-1")
           .option("escape", '"').csv(path))
    opts = {"allowSingleQuotes": "true"}
    pas = T.ArrayType(T.StructType([T.StructField("action", T.StringType()), T.StructField("sg", T.StringType()),
                                    T.StructField("idx", T.StringType())]))
    return raw.select(
        F.col("variations").cast("long").alias("variations"),
        "chatgpt_output",
        F.from_json("subgoal", T.ArrayType(T.StringType()), opts).alias("subgoal"),
        F.transform(F.from_json("path_act_sg", pas, opts),
                    lambda x: F.struct(x["action"].alias("action"), x["sg"].alias("sg"),
                                       x["idx"].try_cast("int").alias("idx"))).alias("path_act_sg"),
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Prompt message file(s); their order is the ``turn`` column (file order is
    not a Spark guarantee), sorting is the consumer's."""
    return spark.read.schema(MESSAGE_SCHEMA).json(path)


def prompt_for_task(bank: DataFrame, tasks: DataFrame, task: str = "taskIdx", pos: str = "bank_pos") -> DataFrame:
    """The bank row whose ``taskIdx`` equals the task; the last match (by
    bank position) wins; tasks without a row come back with nulls."""
    cols = [c for c in bank.columns if c not in (task, pos)]
    best = bank.groupBy(task).agg(F.max_by(F.struct(*cols), pos).alias("_row"))
    out = tasks.join(best, task, "left")
    return out.select(task, *[F.col("_row")[c].alias(c) for c in cols])
