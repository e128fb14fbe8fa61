"""Episodes of every size go through the same blocks: long ones give exactly what
one plain window gives."""

import tempfile

import pytest
from conftest import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajframe.operators import blocks
from trajframe.operators import windows as W
from trajframe.plans.catalog import load_all

BLOCKED = ["project_step_io", "win_reward", "win_history", "win_last_k", "win_next_subgoal", "win_subgoal_runs", "win_visited_rooms",
           "win_loop_stop", "win_stall_stop", "win_negative_stop", "win_segment_markers", "win_clean_history", "win_repeat_collapse",
           "win_move_collapse", "win_exclude_recent", "win_running_match", "agg_episode_final", "filter_noise_steps",
           "compose_action_sg", "compose_action_formal", "compose_subgoal", "win_seen_objects", "win_seen_objects_final"]


@pytest.mark.parametrize("name", BLOCKED)
def test_small_blocks_equal_whole_episodes(spark, monkeypatch, name):
    fn = load_all()[name][0]
    whole = sorted(map(tuple, fn(spark, SF_SMALL).collect()), key=repr)
    monkeypatch.setattr(blocks, "BLOCK", 6)          # every episode is long, frames reach over several chunks
    cut = sorted(map(tuple, fn(spark, SF_SMALL).collect()), key=repr)
    assert len(whole) > 0 and cut == whole


@pytest.fixture(scope="module")
def one_long_episode(spark):
    """A table folder whose events are almost all of one user, in uneven time, with ties."""
    folder = tempfile.mkdtemp(prefix="long-episode-", dir="/tmp")
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase", "error", "signup"))), (F.pmod(F.xxhash64(i), F.lit(5)) + 1).cast("int"))
    seconds = F.when(i % 3 == 0, F.floor(i / 50)).otherwise(i * 2)
    rows = spark.range(0, 1_500_000).select(
        i.alias("event_id"), F.timestamp_seconds(seconds + 1_700_000_000).alias("ts"), F.when(i % 50 == 0, i % 7).otherwise(3).alias("user_id"),
        kind.alias("event_type"), (i / 7).alias("value"), F.concat(F.lit('{"k": '), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(100)).cast("string"), F.lit("}")).alias("props"))
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


def test_long_episode_equals_row_number(spark, one_long_episode):
    events = spark.read.parquet(f"{one_long_episode}/events.parquet")
    got = load_all()["win_reward"][0](spark, one_long_episode)
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    plain = (events.withColumn("k", k).where(~((F.col("event_type") == "view") | ((F.col("event_type") == "error") & (F.col("k") % 2 == 0))))
             .withColumn("variation_id", F.col("user_id")).withColumn("score", ((F.col("k") - 2) / F.lit(100.0)).cast("double"))
             .withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
             .withColumn("action", F.lit("a")).withColumn("observation", F.lit("o")))
    want = W.with_history_state(plain, ["variation_id"]).select("variation_id", "step", F.round("reward", 6).alias("reward"))
    got = got.select("variation_id", "step", "reward")
    sums = [F.count(F.lit(1)), F.sum("step"), F.max("step"), F.sum(F.pmod(F.xxhash64("variation_id", F.col("step").cast("long"), "reward"), F.lit(2**31)))]
    assert tuple(got.agg(*sums).first()) == tuple(want.agg(*sums).first())
    assert got.where("variation_id = 3").select("step").distinct().count() == got.where("variation_id = 3").count() > 1_000_000


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 10)
    df = spark.range(0, 1000).select(F.floor(F.col("id") % 10 / 9).alias("k"), F.timestamp_seconds("id").alias("t"), "id")
    b = blocks.time_blocks(df, ["k"], "t")
    assert b.groupBy("k", "_blk").count().agg(F.max("count")).first()[0] <= 11
    n = blocks.number(b, ["k"], ["t", "id"], "n")
    w = Window.partitionBy("k").orderBy("t", "id")
    assert n.withColumn("_w", F.row_number().over(w) - 1).where("n <> _w").count() == 0


@pytest.mark.parametrize("spoiled", ["one without time", "one far ahead", "all equal", "half without time", "most in one second"])
def test_blocks_of_spoiled_times_are_bounded(spark, monkeypatch, spoiled):
    monkeypatch.setattr(blocks, "BLOCK", 1000)
    i = F.col("id")
    seconds = {"one without time": F.when(i != 7, i), "one far ahead": F.when(i == 7, 250_000_000_000).otherwise(i), "all equal": F.lit(5),
               "half without time": F.when(i % 2 == 0, i), "most in one second": F.when(i % 20 == 0, i).otherwise(77)}[spoiled]
    df = spark.range(0, 20_000).select(F.lit(1).alias("k"), F.timestamp_seconds(seconds).alias("t"), i)
    b = blocks.time_blocks(df, ["k"], "t", ["id"])
    depth = [r["count"] for r in b.groupBy("_blk").count().collect()]
    assert max(depth) <= 2000 and len(depth) == 20
    n = blocks.number(b, ["k"], ["t", "id"], "n")
    assert n.withColumn("_w", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1).where("n <> _w").count() == 0


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_objects_of_long_episodes_by_a_plain_fold(spark, monkeypatch, limit):
    """Lists that are carried through many chunks (limit 50), or forgotten at once."""
    monkeypatch.setattr(blocks, "BLOCK", 7)
    looks = [[f"thing{(i * i * 7 + e) % 11}", f"thing{i % 3}"][: 1 + (i % 4 == 0)] if i % 9 < 4 else [] for e in range(2) for i in range(100)]
    rows = [(0, e, i, 1 if e == 0 else None, "This room is called the hall. In it, you see: \n" + "".join(f"\ta {t}\n" for t in looks[e * 100 + i]))
            for e in range(2) for i in range(100)]
    steps = spark.createDataFrame(rows, "task_no long, variation_id long, step long, _nb long, freelook string").repartition(5)
    got = {(r.variation_id, r.step): list(r.objects) for r in W.with_objects(steps, limit).collect()}
    for e in range(2):
        held = []
        for i in range(100):
            if i >= 1:
                for t in looks[e * 100 + i]:
                    if "a " + t not in held:
                        held.append("a " + t)
                held = held[-limit:]
            assert got[e, i] == held, (e, i)
