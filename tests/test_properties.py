"""Property checks: alignment scripts, round trips, split disjointness."""

from hypothesis import given, settings
from hypothesis import strategies as st

from trajframe.operators.annotate import edit_script


def apply_script(gold, ann, ops):
    """Apply (op, i, j): remove ann[j]; add gold[i] before ann[j]."""
    removed = {j for op, i, j in ops if op == "remove"}
    adds = {}
    for op, i, j in ops:
        if op == "add":
            adds.setdefault(j, []).append(gold[i])
    out = []
    for j, a in enumerate(ann):
        out += adds.get(j, [])
        if j not in removed:
            out.append(a)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), min_size=1, max_size=8))
def test_script_turns_annotation_into_gold(gold, ann):
    ann = ann[:-1] + [gold[-1]]          # the last elements are forced equal
    d, ops = edit_script(gold, ann)
    assert d == len(ops)
    assert apply_script(gold, ann, ops) == gold


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=10))
def test_identical_sequences_have_no_edits(xs):
    assert edit_script(xs, list(xs)) == (0, [])


VERBS = ["focus on", "look at", "look around", "read", "pick up", "open door to", "close door to", "open", "close",
         "activate", "deactivate", "go to", "teleport to", "examine", "connect", "move", "use", "pour", "dunk", "mix",
         "drop", "wait", "wait1", "0", "1", "end subgoal", "eat", "FOCUS(", "WAIT(", "SEE()", "PICK_UP(", "OPEN_DOOR(",
         "MOVE(", "DROP(", "CHOOSE(0)"]
WORDS = ["a", "to", "in", "into", "on", "cup", "metal pot", ",", ")", "(", " ", "\t", "\n", "x y"]


def test_dispatched_rules_equal_plain_chain(spark):
    """The first-word dispatch gives exactly the ordered chain's answer."""
    import random
    from trajframe.functions.actions import formalize, formalize_chain, recover, recover_chain
    rnd = random.Random(7)
    texts = set()
    for _ in range(3000):
        t = rnd.choice(VERBS)
        for _ in range(rnd.randint(0, 4)):
            t += rnd.choice([" ", ""]) + rnd.choice(WORDS)
        if rnd.random() < 0.2:
            t = rnd.choice([" ", "\t", ""]) + t + rnd.choice([" ", "\n", ""])
        texts.add(t)
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "t string")
    bad = df.where(~formalize("t").eqNullSafe(formalize_chain("t")) | ~recover("t").eqNullSafe(recover_chain("t")))
    assert bad.count() == 0, bad.limit(5).collect()
