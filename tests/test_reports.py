"""Counts of the running query and side tables of the same write."""

from pyspark.sql import functions as F

from trajframe.operators import reports as RP
from trajframe.operators import sampling as T


def test_answers_in_one_pass(spark, tmp_path):
    answers = ["1- go(k): {'a', 'b'}", "no items", "", None, "2- x(y): {'c'} 3- z(): {'d'}"]
    df = spark.createDataFrame([(0, i, a) for i, a in enumerate(answers)], "task_no long, variation_id long, answer string")
    counts = RP.write_checked(df, str(tmp_path / "checked"), "answers", RP.answer_faults())
    assert counts == {"rows": 5, "no answer": 2, "no item": 1}
    good, bad = RP.accepted_rows(spark, str(tmp_path / "checked")), RP.rejected_rows(spark, str(tmp_path / "checked"))
    assert sorted(r.variation_id for r in good.collect()) == [0, 4] and good.columns == df.columns
    assert sorted((r.variation_id, r.fault) for r in bad.collect()) == [(1, "no item"), (2, "no answer"), (3, "no answer")]


def test_misses_and_short_heads_are_counted_while_they_run(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "name") for i in range(10)], "task_no long, task_name string")
    rows, seen = RP.watched(df, "tasks", RP.task_faults())
    assert rows.where("task_no >= 0").count() == 10 and seen.get == {"rows": 10, "unknown task": 4}
    head, seen = RP.watched(T.head(df, 20, ["task_no"]), "head", {})
    assert head.count() == 10 and RP.too_few(seen, 20) and not RP.too_few(seen, 10)


def test_first_fault_counts(spark):
    df = spark.createDataFrame([("a", None), ("a", "b"), ("a", "a")], "action string, annotated string")
    got = [r.f for r in df.select(RP.fault_of(RP.label_faults()).alias("f")).collect()]
    assert got == ["no annotation", "another action", "none"]
    assert RP.summary(spark, {"x": {"rows": 3}}).first().asDict() == {"report": "x", "fault": "rows", "n": 3}
    assert df.select(F.count_if(RP.fault_of(RP.label_faults()) == RP.NONE)).first()[0] == 1
