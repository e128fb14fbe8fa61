"""Example composition (C1-C10, C16): steps -> training examples.

One parametrised operator, ``compose(steps, recipe)``.  The recipe picks the
label, the sub-goal block, the history length/formatting and whether the
visited-rooms block is shown; every text piece is a built-in ``concat`` /
``array_join`` so the whole job is one sort per episode plus codegen'd
projections.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import formalize
from ..functions.text import drop_phrases, sanitize
from . import windows as W
from .blocks import carried, chunked
from .windows import EPISODE

Q_ACTION = " What action should you do next? </s> "
Q_SUBTASK = " . What subtask should you do next? </s> "
Q_ACTION_DOT = " . What action should you do next? </s> "
Q_FIRST = (" . You just have started this task. You did not do any actions yet. "
           "What is the first subtask you should do? </s> ")


@dataclass(frozen=True)
class Recipe:
    label: str            # formal_action | raw_action | next_subgoal
    subgoals: str         # none | current_last | current_second_last | test_last | v4_second_last
    history: int          # items of history shown (10 or 1)
    formal_history: bool
    rooms: bool
    question: str


# the ten example templates
RECIPES: dict[str, Recipe] = {
    "action_sg": Recipe("formal_action", "current_last", 10, True, True, Q_ACTION),                 # C1
    "subgoal": Recipe("next_subgoal", "current_second_last", 10, True, True, Q_SUBTASK),            # C2
    "subgoal_eval": Recipe("next_subgoal", "test_last", 10, True, True, Q_SUBTASK),                 # C3
    "subgoal_v4": Recipe("next_subgoal", "v4_second_last", 10, True, True, Q_ACTION_DOT),           # C4
    "action_sg_nohist": Recipe("formal_action", "current_last", 1, True, True, Q_ACTION),           # C5
    "action_formal": Recipe("formal_action", "none", 10, True, True, Q_ACTION),                     # C6
    "action_raw": Recipe("raw_action", "none", 10, False, True, Q_ACTION),                          # C7
    "action_raw_nohist": Recipe("raw_action", "none", 1, False, True, Q_ACTION),                    # C8
    "action_raw_norooms": Recipe("raw_action", "none", 1, False, False, Q_ACTION),                  # C9
}


def _join(arr: Column) -> Column:
    return F.array_join(arr, ", ")


def _subgoal_block(kind: str) -> Column | None:
    sg = F.col("subgoals")
    n = F.size(sg)
    last = F.element_at(sg, -1)
    if kind == "none":
        return None
    if kind == "current_last":      # C1/C5: all but last (if >1) / last
        done = F.when(n > 1, F.concat(F.lit(". Completed subtasks are: "), _join(F.slice(sg, 1, n - 1)))) \
            .otherwise(F.lit(". No completed subtasks"))
        return F.concat(done, F.lit(". The current subtask is "), last)
    if kind == "current_second_last":  # C2: all but last 2 (if >2) / second last (if >1)
        done = F.when(n > 2, F.concat(F.lit(". Completed subtasks are: "), _join(F.slice(sg, 1, n - 2)))) \
            .otherwise(F.lit(". No completed subtasks"))
        cur = F.when(n > 1, F.concat(F.lit(". The current subtask is "), F.element_at(sg, -2))).otherwise(F.lit(""))
        return F.concat(done, cur)
    if kind == "test_last":         # C3: all but last (if >1) / last (if >0)
        done = F.when(n > 1, F.concat(F.lit(". Completed subtasks are: "), _join(F.slice(sg, 1, n - 1)))) \
            .otherwise(F.lit(". No completed subtasks"))
        cur = F.when(n > 0, F.concat(F.lit(". The current subtask is "), last)).otherwise(F.lit(""))
        return F.concat(done, cur)
    if kind == "v4_second_last":    # C4: all but last 2 (if >1) / second last; < 2 sub-goals has no input
        done = F.when(n > 1, F.concat(F.lit(". Completed subtasks are: "), _join(F.slice(sg, 1, F.greatest(n - 2, F.lit(0)))))) \
            .otherwise(F.lit(". No completed subtasks"))
        return F.when(n >= 2, F.concat(done, F.lit(". The current subtask is "), F.element_at(sg, -2)))
    raise ValueError(kind)


def _finish(text: Column) -> Column:
    return drop_phrases(sanitize(text))


def _features(steps: DataFrame, r: Recipe, episode: Sequence[str]) -> DataFrame:
    """Window features of a recipe, on chunks of each episode (``blocks``); the
    running room and sub-goal lists are carried from chunk to chunk."""
    def windows(d, keys):
        d = W.with_history_state(d, keys)
        if r.rooms:
            d = W.with_rooms(d, keys)
        if r.subgoals != "none":
            d = W.with_subgoal_runs(d, keys)
        if r.label == "next_subgoal":
            d = W.with_next_subgoal(d, keys)
        return W.add_history(d, r.history, r.formal_history, keys)

    # history items reach r.history rows back and each item's reward one more
    df = chunked(steps, list(episode), "step", r.history + 1, 1, windows, keep=True)
    if r.rooms:
        df = carried(df, list(episode), "step", "places").withColumn("places", F.array_distinct("places"))
    if r.subgoals != "none":
        df = carried(df, list(episode), "step", "subgoals")
    return df


def compose(steps: DataFrame, recipe: Recipe | str, episode: Sequence[str] = EPISODE,
            task_desc: str = "task_desc") -> DataFrame:
    """Steps (with ``step``, ``action``, ``observation``, ``score``,
    ``freelook``, ``inventory`` and, for sub-goal recipes, ``subgoal``) ->
    one example per step i >= 1: ``input``, ``target`` plus the episode keys
    and ``step``.  An action that cannot be formalised gives a null target
    (the original job stops there)."""
    r = RECIPES[recipe] if isinstance(recipe, str) else recipe
    return _assemble(_features(steps, r, episode).where(F.col("step") >= 1), r, episode, task_desc)


def _assemble(df: DataFrame, r: Recipe, episode: Sequence[str], task_desc: str) -> DataFrame:
    pieces: list[Column] = [
        F.col(task_desc), F.lit(" </s> Time: "), F.col("step").cast("string"),
        F.lit("; Score: "), W.trunc100(F.col("prev_score")).cast("string"), F.lit("; </s> "),
    ]
    block = _subgoal_block(r.subgoals)
    if block is not None:
        pieces.append(block)
    pieces += [
        F.lit("Action history: </s>"), F.col("history"), F.lit(" </s> "),
        F.lit("Current environment: "), F.col("freelook"), F.lit(" </s> "),
        F.lit("Current inventory: "), F.col("inventory"), F.lit(" </s> "),
    ]
    if r.rooms:
        pieces.append(F.when(F.size("places") > 0,
                             F.concat(F.lit("Visited rooms: "), _join(F.col("places")), F.lit(" </s> ")))
                      .otherwise(F.lit("")))
    pieces.append(F.lit(r.question))
    text = _finish(F.concat(*pieces))

    if r.label == "formal_action":
        target = formalize(sanitize("action"))
    elif r.label == "raw_action":
        target = sanitize("action")
    else:
        target = F.col("next_subgoal")
    keep = [c for c in (*episode, "fold", "step") if c in df.columns]
    return df.select(*keep, text.alias("input"), target.alias("target"))


def compose_first_subgoal(steps: DataFrame, episode: Sequence[str] = EPISODE,
                          task_desc: str = "task_desc") -> DataFrame:
    """One example per episode from its first step (no history, no
    rooms yet, time 1, score 0); the label is the first sub-goal."""
    first = steps.where(F.col("step") == 0)
    text = F.concat(
        F.col(task_desc), F.lit(" </s> Time: 1; Score: 0; </s> "),
        F.lit("Current environment: "), F.col("freelook"), F.lit(" </s> "),
        F.lit("Current inventory: "), F.col("inventory"), F.lit(" </s> "),
        F.lit(Q_FIRST),
    )
    keep = [c for c in (*episode, "fold") if c in steps.columns]
    return first.select(*keep, _finish(text).alias("input"), F.col("subgoal").alias("target"))
