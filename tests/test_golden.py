"""Golden cases derived by hand from the original code (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from trajframe.functions.actions import formalize, recover
from trajframe.functions.text import sanitize, strip_generation
from trajframe.operators import annotate as L
from trajframe.operators import joins as J
from trajframe.operators import sampling as T
from trajframe.operators import windows as W
from trajframe.sources.tables import task_dimension


def test_formalize_recover_demo(spark):
    cases = [
        ("focus on metal pot", "FOCUS(metal pot)", "focus on metal pot"),
        ("look around", "SEE()", "look around"),
        ("open door to art studio", "OPEN_DOOR(art studio)", "open door to art studio"),
        ("move metal pot to stove", "MOVE(metal pot, stove)", "move metal pot to stove"),
        ("pour cup1 in inventory in art studio in cup2", "POUR(cup1 in inventory in art studio, cup2)",
         "pour cup1 in inventory in art studio into cup2"),
        ("mix obj1 and obj2 and obj3", "MIX(obj1 and obj2 and obj3)", "mix obj1 and obj2 and obj3"),
        ("drop light", "DROP(light)", "drop light"),
        ("deactivate sink", "DEACTIVATE(sink)", "deactivate sink"),
        ("wait1", "WAIT()", "wait"),
        ("end subgoal", "END_SG()", None),
        ("eat apple", None, None),
        ("use lamp", None, None),
    ]
    df = spark.createDataFrame([(a,) for a, _, _ in cases], "a string")
    got = df.select("a", formalize("a").alias("f")).select("a", "f", recover("f").alias("r")).collect()
    m = {r.a: (r.f, r.r) for r in got}
    for a, f, r in cases:
        assert m[a] == (f, r), a


def test_sanitize_and_strip(spark):
    df = spark.createDataFrame([("a\n\tb green house", "<pad><extra_id_0> go to hall<extra_id_1></s>")], "s string, g string")
    r = df.select(sanitize("s").alias("s"), strip_generation("g").alias("g")).first()
    assert r.s == "a | b greenhouse"
    assert r.g == "go to hall"


def test_edit_script_cases():
    assert L.edit_script([1, 2, 3, 4, 5, 6, 7], [1, 2, 44, 3, 4, 60, 7]) == (
        4, [("remove", 2, 2), ("add", 4, 5), ("add", 5, 5), ("remove", 6, 5)])
    d, ops = L.edit_script([1, 2], [3, 4])
    assert d == 2 and [o for o in ops if o[0] == "add"] == [("add", 0, 0)] and [o[2] for o in ops if o[0] == "remove"] == [0]
    assert L.edit_script([1, 2, 9], [1, 9]) == (1, [("add", 1, 1)])


def _steps(spark, rows, cols="task_no long, variation_id long, step int, action string, observation string, score double"):
    return spark.createDataFrame(rows, cols)


def test_sentinel_history_and_reward(spark):
    rows = [(0, 1, i, f"a{i}", f"o{i}", s) for i, s in enumerate([0.10, 0.25, 0.25, 0.50])]
    h = W.with_history_state(_steps(spark, rows))
    w = W.w_ep()
    out = h.withColumn("items", F.collect_list(F.struct("h_action", "h_obs", "h_score", "reward")).over(
        w.rowsBetween(-100, -1))).orderBy("step").collect()
    assert [tuple(x) for x in out[1]["items"]] == [("look around", "N/A", 0.0, 0.0)]
    assert tuple(out[2]["items"][-1]) == ("a1", "o1", 0.25, 0.25)
    assert tuple(out[3]["items"][-1]) == ("a2", "o2", 0.25, 0.0)
    assert all(x["h_action"] != "a0" for r in out for x in (r["items"] or []))


def test_last_k_tags(spark):
    rows = [(0, 1, i, "look around", f"o{i}", 0.0) for i in range(13)]
    h = W.last_k(_steps(spark, rows), 10, formal=False).orderBy("step").collect()
    t12 = h[12]["history"]
    assert t12.count("<extra_id_") == 10 and t12.startswith(" <extra_id_10>") and "<extra_id_1>" in t12
    t3 = h[3]["history"]
    assert [p.split(">")[0] for p in t3.split("<extra_id_")[1:]] == ["10", "9", "8"]


def test_next_subgoal(spark):
    df = spark.createDataFrame([(0, 1, 0, "A"), (0, 1, 1, "B")], "task_no long, variation_id long, step int, subgoal string")
    out = {r.step: r.next_subgoal for r in W.with_next_subgoal(df).collect()}
    assert out == {0: "B", 1: "complete_task()"}


def test_object_fifo_reentry(spark):
    looks = ["This room. a a\n", "x", "a b\na c\n", "a a\n"]
    # mention lists: step1 -> [b, c] ; step2 -> [a] ... build directly from looks with mentions
    rows = [(0, 1, 0, "ignored"), (0, 1, 1, "a b\na b2\n"), (0, 1, 2, "a c\n"), (0, 1, 3, "a b\n")]
    df = spark.createDataFrame(rows, "task_no long, variation_id long, step int, freelook string")
    out = {r.step: r.objects for r in W.with_objects(df, limit=2).collect()}
    assert out[1] == ["a b", "a b2"]
    assert out[2] == ["a b2", "a c"]
    assert out[3] == ["a c", "a b"]          # evicted "a b" re-enters at the tail
    fin = W.final_objects(df, 2).first().objects
    assert fin == ["a c", "a b"]
    del looks


def test_loop_stop(spark):
    acts = ["A", "B"] * 5
    rows = [(0, 1, i, a, "o", 0.5) for i, a in enumerate(acts[:9])]
    assert W.stop_step(_steps(spark, rows), lambda k: W.loop_flag(10, "action", k), 9).first().stop_step is None
    rows = [(0, 1, i, a, "o", 0.5) for i, a in enumerate(acts)]
    assert W.stop_step(_steps(spark, rows), lambda k: W.loop_flag(10, "action", k), 9).first().stop_step == 9


def test_negative_stop(spark):
    rows = [(0, 1, i, "a", "o", s) for i, s in enumerate([0.0, 0.40, -1.0])]
    f = W.finals(_steps(spark, rows), limit=100, loop_k=None).first()
    assert (f.end_step, f.final_score) == (2, 0.0)
    f = W.finals(_steps(spark, rows), limit=100, loop_k=None, no_stop=True).first()
    assert (f.end_step, f.final_score) == (2, 0.40)


def test_test_fold_cap(spark):
    eps = spark.createDataFrame([(0, i, f) for i, f in enumerate(["train", "test", "train", "test", "train"])],
                                "task_no long, variation_id long, fold string")
    kept = sorted(r.variation_id for r in T.cap_test_episodes(eps, 2).collect())
    assert kept == [0, 1, 2]


def test_segment_markers(spark):
    rows = [(0, 1, i, f"a{i}", "o", 0.1, sg) for i, sg in enumerate("AABC")]
    df = spark.createDataFrame(rows, "task_no long, variation_id long, step int, action string, observation string, score double, subgoal string")
    out = W.insert_markers(df).orderBy("step").collect()
    assert [(r.action, r.subgoal) for r in out] == [("a0", "A"), ("a1", "A"), ("end subgoal", "A"), ("a2", "B"),
                                                    ("end subgoal", "B"), ("a3", "C")]
    runs = W.subgoal_runs(df).orderBy("step").collect()[-1].subgoals
    assert runs == ["A", "B", "C"]


def test_token_overlap(spark):
    preds = spark.createDataFrame([(1, 1, "pick up red pot")], "g long, rnk int, action string")
    cands = spark.createDataFrame([(1, "pick up pot"), (1, "pick up red cup")], "g long, action string")
    assert J.nearest_by_tokens(preds, cands, ["g"]).first().action == "pick up pot"


def test_task_name_and_real_id(spark):
    df = spark.createDataFrame([("task-1-boil",), ("mendelian-genetics-known-plant",)], "task_name string")
    out = {r.task_name: r.task_real_id for r in J.with_real_id(df, task_dimension(spark)).collect()}
    assert out == {"task-1-boil": "1-1", "mendelian-genetics-known-plant": "10-1"}


def test_explode_annotations(spark):
    df = spark.createDataFrame([(1, "1- go(k): {'a b', 'c'} 2- hold(x):{'d'}")], "variation_id long, answer string")
    out = [(r.sg_no, r.sg, r.act_no, r.action) for r in L.explode_annotations(df, ["variation_id"]).orderBy("idx").collect()]
    assert out == [(1, "go(k)", 1, "a b"), (1, "go(k)", 2, "c"), (2, "hold(x)", 1, "d")]
