"""Readers for the driver's parquet tables and the episode binding.

``events`` is bound to episodes of steps exactly as described in
FIXTURES.md §2 (``v_steps``): one user is one episode, the event type and the
integer ``k`` in ``props`` pick the action / observation text.  Only the
columns each reader needs are selected so the parquet scan prunes the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import TASK_TABLE

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# --- fixed values: names used by the events -> steps binding (FIXTURES §2) --
BINDING_ROOMS = ["hallway", "greenhouse", "kitchen", "bathroom", "outside", "workshop",
                 "art studio", "foundry", "bedroom", "living room"]
BINDING_OBJECTS = ["metal pot", "orange", "thermometer", "glass cup", "apple seed", "picture", "red wire"]
BINDING_SUBGOAL_ROOMS = ["kitchen", "workshop", "outside"]
N_TASKS = 30


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def _pick(values: list[str], idx) -> F.Column:
    """values[idx] (0-based) for an int Column ``idx``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def events_as_steps(events: DataFrame, position: bool = True, order: bool = False,
                    keep: Sequence[str] = (), only: F.Column | None = None, number_as: str | None = None) -> DataFrame:
    """``events`` -> long step table ``v_steps`` (one row per event).

    Output: variation_id, task_no, fold, pos, action, observation, score,
    freelook, inventory, subgoal.  ``position=False`` leaves ``pos`` out;
    ``order`` keeps the order columns and blocks (see ``operators.blocks``); without
    either the rows are a plain projection, for streams too, with columns to ``keep``.
    ``only`` filters the steps by their ``action``; ``number_as`` numbers those left.  Blocks
    and numbers are made of the narrow event rows, the texts of a step after them.
    """
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    b = events.select("user_id", "event_id", "ts", "event_type", k.alias("k"))
    texts = {"room": _pick(BINDING_ROOMS, F.col("k") % 10), "obj": _pick(BINDING_OBJECTS, F.col("k") % 7)}
    grp = F.floor(F.col("variation_id") / 30).cast("int") % 5
    fold = F.when(grp.isin(1, 4), "test").when(grp == 3, "dev").otherwise("train")
    from ..operators.blocks import number, time_blocks
    b = b.withColumn("variation_id", F.col("user_id"))
    if position or order:
        b = time_blocks(b, ["variation_id"], "ts", ["event_id"])
    if position:
        b = number(b, ["variation_id"], ["ts", "event_id"], "pos")
    et, kk = F.col("event_type"), F.col("k")
    action = (
        F.when(et == "view", F.lit("look around"))
        .when(et == "error", F.when(kk % 2 == 0, F.concat(F.lit("close door to "), "room"))
              .otherwise(F.concat(F.lit("eat "), "obj")))
        .when(et == "click", F.when(kk % 3 == 0, F.concat(F.lit("go to "), "room"))
              .when(kk % 3 == 1, F.concat(F.lit("teleport to "), "room"))
              .otherwise(F.concat(F.lit("open door to "), "room")))
        .when(et == "purchase", F.when(kk % 3 == 0, F.concat(F.lit("pick up "), "obj"))
              .when(kk % 3 == 1, F.concat(F.lit("examine "), "obj"))
              .otherwise(F.lit("wait1")))
        .otherwise(F.concat(F.lit("move "), "obj", F.lit(" to "), "room"))
    )
    if only is not None:
        b = b.withColumns(texts).withColumn("action", action).where(only).drop("action", *texts)
    if number_as:
        b = number(b, ["variation_id"], ["ts", "event_id"], number_as)
    b = b.withColumns(texts)
    observation = (
        F.when(et == "click", F.concat(F.lit("You move to the "), "room", F.lit(".")))
        .when(et == "error", F.lit("No known action matches that input."))
        .otherwise(F.concat(F.lit("You see the "), "obj", F.lit(".")))
    )
    freelook = F.concat(
        F.lit("This room is called the "), "room", F.lit(". In it, you see: \n\tthe agent\n\ta "),
        "obj", F.lit(" (that is open)\n\ta substance called air\nYou also see:\n\tA door to the "),
        "room", F.lit("\n"),
    )
    sg_room = _pick(BINDING_SUBGOAL_ROOMS, F.floor(kk / 34))
    return b.select(
        "variation_id",
        (F.col("variation_id") % N_TASKS).alias("task_no"),
        fold.alias("fold"),
        *(["pos"] if position else []),
        *(["ts", "event_id", "_nb", "_blk"] if order else keep),
        action.alias("action"),
        observation.alias("observation"),
        ((kk - 2) / F.lit(100.0)).cast("double").alias("score"),
        freelook.alias("freelook"),
        F.concat(F.lit("In your inventory, you see: a "), "obj").alias("inventory"),
        F.concat(F.lit("visit("), sg_room, F.lit(")")).alias("subgoal"),
        *([number_as] if number_as else []),
    )


def task_dimension(spark: SparkSession) -> DataFrame:
    """30-row task dimension: task_no (position), task_name, task_real_id,
    task_group.  Tiny and fixed, so it is always safe to broadcast."""
    rows = [(i, name, rid, rid.split("-")[0]) for i, (name, rid) in enumerate(TASK_TABLE)]
    return spark.createDataFrame(rows, "task_no long, task_name string, task_real_id string, task_group string")


def task_description(task_name: F.Column) -> F.Column:
    """Episode task text of the binding: ``Your task is to <name with spaces>.``"""
    return F.concat(F.lit("Your task is to "), F.translate(task_name, "-", " "), F.lit("."))
