"""What grows with the steps is neither broadcast, nor sorted wide, nor one task's state."""

from pyspark.sql import functions as F

from trajframe.operators import annotate as L
from trajframe.session import cut


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_greedy_walk_broadcasts_no_rows(spark):
    """Written rows lie in small files, which alone would have them broadcast."""
    gold = cut(spark.range(40).select(F.floor(F.col("id") / 10).alias("variation_id"), (F.col("id") % 10).alias("step"),
                                      F.concat(F.lit("go "), F.col("id") % 3).alias("action")), "gold")
    answers = spark.range(5).select(F.col("id").alias("variation_id"), F.lit("1- a(): {'go 0', 'go 1'} 2- b(): {'go 2', 'go 0'} ").alias("answer"))
    items = cut(L.explode_annotations(answers, ["variation_id"]), "items")
    walked = L.greedy_align(gold, items, ["variation_id"])
    assert "Broadcast" not in _plan(walked)
    assert walked.count() > 0 and walked.select("variation_id").distinct().count() == 4


def test_triggers_and_state_partitions_follow_the_input(spark, tmp_path):
    """Many files make larger triggers, not more; a trigger opens a state partition a core."""
    from trajframe.plans import q_misc
    from trajframe.streaming import state as R
    log = str(tmp_path / "log")
    spark.range(240).repartition(24).write.parquet(log)
    assert q_misc._files_per_trigger(spark, log) == 24 // q_misc.STREAM_FILES
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with R.state_partitions(spark, log):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbers_are_made_of_narrow_rows(spark):
    """The texts of a step are written after its number, not sorted with it."""
    from conftest import SF_SMALL
    from trajframe.plans.views import v_f_plain
    sorted_below = v_f_plain(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)[1]
    assert "This room is called" not in sorted_below


def test_repair_broadcasts_no_rows(spark):
    steps = cut(spark.range(40).select(F.floor(F.col("id") / 10).alias("variation_id"), (F.col("id") % 10).alias("step"),
                                       F.concat(F.lit("go "), F.col("id") % 3).alias("action"), F.lit("s").alias("subgoal"), F.lit(None).alias("_nb")), "gold")
    ann = cut(steps.where("step <> 4").drop("_nb"), "annotation")
    repaired = L.repair(cut(L.align(steps, ann, ["variation_id"]), "edits"), steps, ann, ["variation_id"])
    assert "Broadcast" not in _plan(repaired)
    assert repaired.count() == 40
