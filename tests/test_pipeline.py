"""End-to-end checks on the driver tables: entry point, stream = batch,
split disjointness, formalise/recover losses."""

import importlib

from pyspark.sql import functions as F

from conftest import SF_SMALL
from trajframe.operators import windows as W
from trajframe.plans import q_misc
from trajframe.plans.views import v_f, v_f_plain
from trajframe.streaming import state as R


def test_entry_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0 and {"input", "target"} <= set(df.columns)
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 100


def test_stream_state_equals_batch(spark):
    d = q_misc._stream_input(spark, SF_SMALL)
    s = R.stream_state(R.event_steps(R.read_event_stream(spark, d)), watermark=q_misc.STREAM_DELAY, object_limit=20,
                       gap=q_misc.STREAM_GAP)
    got = q_misc._run_stream(spark, s, "t-r1").where("variation_id >= 0").select(
        "variation_id", "step", "action", F.round("reward", 6).alias("reward"), "places", F.col("objects"))
    f = v_f_plain(spark, SF_SMALL)
    b = W.with_objects(W.with_rooms(W.with_history_state(f)), limit=20)
    want = b.select("variation_id", "step", "action", F.round("reward", 6).alias("reward"),
                    F.when(F.size("places") > 0, F.array_join("places", ", ")).alias("places"),
                    F.array_join("objects", ", ").alias("objects"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_stops_equal_batch_finals(spark):
    from trajframe.plans.q_core import LOOP_K, STEP_LIMIT
    d = q_misc._stream_input(spark, SF_SMALL)
    s = R.stream_state(R.event_steps(R.read_event_stream(spark, d)), watermark=q_misc.STREAM_DELAY, loop_k=LOOP_K,
                       step_limit=STEP_LIMIT, gap=q_misc.STREAM_GAP, mode="stops")
    got = q_misc._run_stream(spark, s, "t-r2").where("variation_id >= 0").select(
        "variation_id", "end_step", F.round("final_score", 6).alias("final_score"))
    want = W.finals(v_f_plain(spark, SF_SMALL), limit=STEP_LIMIT, loop_k=LOOP_K).select(
        "variation_id", "end_step", F.round("final_score", 6).alias("final_score"))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_splits_disjoint(spark):
    f = v_f(spark, SF_SMALL)
    per = f.groupBy("variation_id").agg(F.countDistinct("fold").alias("n"))
    assert per.where("n > 1").count() == 0


def test_stream_running_score_equals_batch_means(spark):
    from trajframe.operators import aggregates as A
    from trajframe.plans.q_core import LOOP_K, STEP_LIMIT
    got = q_misc.q_stream_scores(spark, SF_SMALL)
    fin = W.finals(v_f_plain(spark, SF_SMALL), limit=STEP_LIMIT, loop_k=LOOP_K)
    want = A.mean_scores(fin).select("task_no", F.round("mean_score", 6).alias("mean_score"), "episodes")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_stream_keeps_tasks_of_equal_numbers_apart(spark):
    """Two tasks share variation numbers; rows come late, in any order, over several files."""
    from datetime import datetime, timedelta

    from trajframe.sources import sinks as K
    look = "This room is called the {}. In it, you see: \n\ta {}\n"
    start, rows = datetime(2024, 1, 1), []
    for task in (3, 8):
        for variation in (1, 2):
            for i in range(30):
                rows.append((task, variation, start + timedelta(minutes=i * (2 if task == 3 else 3)), i, f"pick up thing {(i * task) % 7}", (i % (task + 2)) / 10.0,
                             f"You move to the room{(i + task) % 3}.", look.format(f"room{(i * task) % 4}", f"thing{(i * variation + task) % 5}")))
    schema = "task_no long, variation_id long, ts timestamp, event_id long, action string, score double, observation string, freelook string"
    steps = spark.createDataFrame(rows, schema)
    d = K.scratch_dir(spark, "shared-numbers")
    for part in range(3):
        steps.where(F.floor(F.col("event_id") / 10) == part).repartition(4, F.xxhash64("event_id")).write.mode("append").parquet(d)
    for i in (1, 2):
        spark.createDataFrame([(0, -1, start + timedelta(days=3 * i), -i, "wait", 0.0, "", "")], schema).write.mode("append").parquet(d)
    stream = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 3).parquet(d)
    got = q_misc._run_stream(spark, R.stream_state(stream, "2 hours", 3, gap="1 day"), "t-shared").where("variation_id > 0")
    f = steps.withColumn("step", F.col("event_id"))
    want = W.with_objects(W.with_rooms(W.with_history_state(f)), limit=3).select(
        "task_no", "variation_id", F.col("step").cast("int").alias("step"), "action", "reward",
        F.when(F.size("places") > 0, F.array_join("places", ", ")).alias("places"), F.array_join("objects", ", ").alias("objects"))
    got = got.select(want.columns)
    assert got.count() == want.count() == 120
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    stops = q_misc._run_stream(spark, R.stream_state(stream, "2 hours", loop_k=5, step_limit=12, gap="1 day", mode="stops"), "t-shared-stops").where("variation_id > 0")
    final = W.finals(f, limit=12, loop_k=5)
    same = stops.select("task_no", "variation_id", F.col("end_step").cast("long").alias("end_step"), "final_score")
    assert same.count() == final.count() == 4 and same.exceptAll(final.select("task_no", "variation_id", "end_step", "final_score")).count() == 0


def test_an_epoch_written_twice_counts_once(spark, tmp_path):
    write = R.write_epoch(str(tmp_path / "metrics"))
    one = spark.createDataFrame([(1, 0.5, 2)], "task_no long, mean_score double, episodes long")
    for epoch in (0, 0, 1):
        write(one, epoch)
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2
