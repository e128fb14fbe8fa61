"""From steps to annotated training files in one call."""

from conftest import SF_SMALL
from pyspark.sql import functions as F

from trajframe.operators.annotate import annotate
from trajframe.operators.datasets import chosen_steps, composed, write_annotated_dataset
from trajframe.plans.q_annotate import v_ann_answers
from trajframe.plans.views import v_f
from trajframe.sources import sinks as K

KEYS = ("task_no", "variation_id")


def test_annotated_files_hold_the_composed_examples(spark):
    steps = v_f(spark, SF_SMALL)
    answers = steps.select(*KEYS).distinct().join(v_ann_answers(spark, SF_SMALL), "variation_id")
    cache = answers.where("variation_id % 2 = 0")

    def answer_fn(need):
        return need.join(answers, list(KEYS))

    def gap_fn(gaps):
        acts = F.array_join(F.transform("missed", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
        return gaps.select(*KEYS, "gap_start", F.concat(F.lit("1- fill(gap): {"), acts, F.lit("} ")).alias("answer"))

    d = K.scratch_dir(spark, "annotated")
    rules = {"rules": [("9-", 2)], "min_len": 2, "test_cap": 5}
    write_annotated_dataset(spark, steps, d, cache, answer_fn, gap_fn, recipes=("action_sg",), mini_n=3, **rules)
    labelled = annotate(chosen_steps(steps, **rules), cache, answer_fn, gap_fn, KEYS)[0]
    want = composed(labelled.drop("source", "is_marker"), "action_sg").select("input", "target")
    got = spark.read.json(f"{d}/action_sg/tasks").select("input", "target")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert got.where("target = 'END_SG()'").count() > 0
    groups = spark.read.json(f"{d}/action_sg/groups")
    assert groups.where("fold <> 'dev.mini'").count() == want.count()
    assert all(r["count"] <= 3 for r in groups.where("fold = 'dev.mini'").groupBy("task_group").count().collect())
    assert spark.read.parquet(f"{d}/answers").where("variation_id % 2 = 0").count() == 0
    assert spark.read.parquet(f"{d}/report").count() == 0
