"""The skew-safe helpers give exactly the single-window answers."""

import json
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajframe.operators import blocks
from trajframe.operators.sampling import cap_test_episodes, dense_index
from trajframe.operators.windows import blocked_running_sum


def test_blocked_running_sum_equals_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"),
                                     (F.col("id") * 7 % 5).alias("v"))
    got = blocked_running_sum(df, ["g"], ["o"], {"rs": F.col("v")}, F.floor(F.col("o") / 37))
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("rs", F.sum("v").over(w))
    assert got.select("g", "o", "rs").exceptAll(want.select("g", "o", "rs")).count() == 0
    assert got.count() == 3000


def test_cap_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    eps = spark.createDataFrame([(0, i, "test" if i % 3 == 1 else "train") for i in range(40)],
                                "task_no long, variation_id long, fold string")
    a = sorted(r.variation_id for r in cap_test_episodes(eps, 5).collect())
    monkeypatch.setattr(blocks, "BLOCK", 1000)
    b = sorted(r.variation_id for r in cap_test_episodes(eps, 5).collect())
    assert a == b == list(range(13))


def test_dense_index_equals_row_number(spark):
    df = spark.range(0, 20000).selectExpr("cast(id * 7 % 20011 as string) as v")
    r = dense_index(df.unionByName(df), "v")
    chk = r.withColumn("rn", F.row_number().over(Window.orderBy(F.md5("v"), "v")) - 1)
    assert r.count() == 20000 and chk.where("rn != index").count() == 0


def test_first_rows_are_those_of_a_sort(spark, monkeypatch):
    from trajframe.operators import blocks
    from trajframe.operators import sampling as T
    monkeypatch.setattr(blocks, "BLOCK", 20)
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("task_no"), F.floor(F.col("id") / 30).alias("variation_id"), (F.col("id") % 10).alias("step"), "id")
    for n in (0, 1, 19, 500, 1000, 5000):
        got = T.head(df, n, ["task_no", "variation_id", "step", "id"])
        want = df.orderBy("task_no", "variation_id", "step", "id").limit(n)
        assert got.count() == want.count() == min(n, 1000) and got.exceptAll(want).count() == 0
        got = T.mini(df, n, 3, ["task_no", "variation_id", "step", "id"])
        want = df.orderBy(T.seeded_key(3, "task_no", "variation_id", "step", "id")).limit(n)
        assert got.count() == min(n, 1000) and got.exceptAll(want).count() == 0
    assert T.head(df.where("false"), 5).count() == 0


def test_running_sums_over_ids_of_any_size(spark, monkeypatch):
    from trajframe.operators import blocks
    from trajframe.operators import sampling as T
    from trajframe.operators import windows as W
    monkeypatch.setattr(blocks, "BLOCK", 50)
    ids = F.pmod(F.xxhash64("id"), F.lit(2**60))
    eps = spark.range(0, 3000).select(F.when(F.col("id") % 4 < 3, 26).otherwise(29).cast("long").alias("task_no"), ids.alias("variation_id"),
                                      F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("fold"), "id")
    depth = blocks.depth_blocks(eps, ["task_no"], ["variation_id"]).groupBy("task_no", "_blk").count()
    assert depth.agg(F.max("count")).first()[0] <= 100 and depth.count() >= 50
    w = Window.partitionBy("task_no").orderBy("variation_id")
    tests = F.sum(F.when(F.col("fold") == "test", 1).otherwise(0)).over(w)
    assert _same(T.cap_test_episodes(eps, 100), eps.withColumn("_t", tests).where("_t < 100").drop("_t"))
    train = eps.where("fold = 'train'").withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("task_no")))
    assert _same(T.pick_variations(eps, "train"), train.where("_r < floor(_n / case when task_no = 26 then 10 else 2 end)").drop("_r", "_n"))
    pairs = eps.select("task_no", "variation_id", F.lit(0).alias("step"), F.lit("a").alias("prediction"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("target"))
    hit = F.avg(F.when(F.col("target") == "a", 100.0).otherwise(0.0)).over(w)
    got = W.running_match(pairs).select("variation_id", F.round("running_match", 9).alias("m"))
    assert _same(got, pairs.select("variation_id", F.round(hit, 9).alias("m")))


def _same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_corpus_order_ends_a_task(spark):
    from trajframe.operators import sampling as T
    rows = [("f1", 0, 0, 9, "train"), ("f1", 0, 1, 8, "test"), ("f1", 0, 2, 1, "train"), ("f2", 0, 0, 7, "test"), ("f2", 0, 1, 2, "train")]
    eps = spark.createDataFrame([(0, *r) for r in rows], "task_no long, source_file string, task_pos int, episode_pos int, variation_id long, fold string")
    assert sorted(r.variation_id for r in T.cap_test_episodes(eps, 2, order=T.CORPUS_ORDER).collect()) == [1, 8, 9]
    steps = eps.withColumn("step", F.lit(0)).withColumn("action", F.concat(F.lit("a"), "variation_id"))
    assert sorted(r.path for r in T.exemplars(steps, 2, order=T.CORPUS_ORDER).collect()) == ["a8, ", "a9, "]


def test_lines_follow_the_examples_over_several_files(spark):
    from trajframe.sources import sinks as K
    d = K.scratch_dir(spark, "lines")
    df = spark.range(0, 4000).select(F.floor(F.col("id") / 100).alias("variation_id"), (F.col("id") % 100).alias("step"),
                                     F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" two\n lines "), "id")).alias("prediction"), F.col("id").alias("task_id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        K.write_predictions(df.repartition(5, "step"), d, order=["variation_id", "step"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = sorted(f for f in os.listdir(d) if f.startswith("part-"))
    lines = [x for f in files for x in open(f"{d}/{f}").read().split("\n")[:-1]]
    assert len(files) > 2 and lines == ["" if i % 7 == 0 else f"two  lines {i}" for i in range(4000)]
    back = K.read_lines(spark, d).collect()
    assert sorted(map(tuple, back)) == list(enumerate(lines))


def test_example_files_are_in_order(spark):
    from trajframe.sources import sinks as K
    d = K.scratch_dir(spark, "ordered")
    df = spark.range(0, 3000).select((F.col("id") % 2).alias("task_id"), F.floor(F.col("id") / 50).alias("variation_id"), (F.col("id") % 50).alias("step"),
                                     F.col("id").cast("string").alias("input"), F.lit("t").alias("target"), F.lit("train").alias("fold"), F.lit("1-1").alias("task_real_id"))
    K.write_examples(df.repartition(7, "input"), d)
    folder = f"{d}/fold=train/task_real_id=1-1"
    got = [int(json.loads(x)["input"]) for f in sorted(os.listdir(folder)) if f.startswith("part-") for x in open(f"{folder}/{f}")]
    assert got == sorted(range(3000), key=lambda i: (i % 2, i // 50, i % 50))
