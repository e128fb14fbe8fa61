"""Projections, filters and predicates.

F1, F2 and F6 are window-based and live in ``windows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import py_strip


def by_fold(df: DataFrame, fold: str, col: str = "fold") -> DataFrame:
    """rows of one fold; unknown folds simply match nothing."""
    return df.where(F.col(col) == fold)


def failed_col(obs: Column | str) -> Column:
    """a failed step's observation: the exact error text, or containing
    ``can't`` / ``not`` / ``doesn't`` (plain substring, so ``nothing`` too)."""
    o = F.col(obs) if isinstance(obs, str) else obs
    cond = o == F.lit(fixed.FAILED_OBSERVATION)
    for m in fixed.FAILED_MARKERS:
        cond = cond | o.contains(m)
    return cond


def flag_failed(steps: DataFrame, obs: str = "observation") -> DataFrame:
    return steps.withColumn("failed", failed_col(obs))


def normalise_task_col(name: Column | str) -> Column:
    """names starting with ``task``: cut through the second ``-`` and drop
    parentheses; others unchanged."""
    n = F.col(name) if isinstance(name, str) else name
    cut = F.translate(F.regexp_replace(n, r"^[^-]*-[^-]*-", ""), "()", "")
    return F.when(n.startswith("task"), cut).otherwise(n)


def normalise_task(df: DataFrame, col: str = "task_name") -> DataFrame:
    return df.withColumn(col, normalise_task_col(col))


def open_doors_only(cands: DataFrame, col: str = "action") -> DataFrame:
    """F8: drop candidates mentioning ``door`` without ``open``."""
    a = F.col(col)
    return cands.where(~(a.contains("door") & ~a.contains("open")))


def visible_focus(cands: DataFrame, col: str = "action", look: str = "freelook",
                  inventory: str = "inventory") -> DataFrame:
    """keep ``focus on X`` only if each word left after removing the words
    focus/on/in/to (case-insensitive) is a substring of
    ``look + " " + lower(inventory)``; blank words always pass.  Other
    candidates pass.  ``cands`` must carry the step's look and inventory."""
    a = F.col(col)
    stop = r"(?i)\b(?:" + "|".join(fixed.FOCUS_STOPWORDS) + r")\b"
    words = F.split(F.regexp_replace(a, stop, ""), " ")
    text = F.concat(F.col(look), F.lit(" "), F.lower(F.col(inventory)))
    ok = F.forall(words, lambda w: F.instr(text, w) > 0)
    return cands.where(~a.startswith("focus on") | ok)


def _task_words(task_text: Column) -> Column:
    # python string.punctuation removed, lower-cased, split on whitespace
    punct = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    cleaned = F.lower(F.translate(task_text, punct, ""))
    return F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")


def task_overlap(cands: DataFrame, col: str = "action", task_id: str = "task_no",
                 task_text: str = "task_desc") -> DataFrame:
    """drop ``focus on`` / ``examine`` candidates sharing no token with the
    task text; tasks 5-8,17-20 keep all focus, 14-16 all examine."""
    a = F.col(col)
    tw = _task_words(F.col(task_text))

    def items(prefix: str) -> Column:
        return F.filter(F.split(F.replace(a, F.lit(prefix), F.lit("")), r"\s+"), lambda w: w != "")

    focus_drop = (a.startswith("focus on") & ~F.col(task_id).isin(fixed.FOCUS_EXEMPT_TASKS)
                  & ~F.arrays_overlap(items("focus on"), tw))
    exam_drop = (a.startswith("examine") & ~F.col(task_id).isin(fixed.EXAMINE_EXEMPT_TASKS)
                 & ~F.arrays_overlap(items("examine"), tw))
    return cands.where(~(F.coalesce(focus_drop, F.lit(False)) | F.coalesce(exam_drop, F.lit(False))))


def relevant_history(steps: DataFrame, demo_types: DataFrame, episode=("task_no",),
                     action: str = "action", obs: str = "observation", demo_text: str = "demo") -> DataFrame:
    """drop history rows whose observation is ``N/A`` or whose formal
    action type (text before ``(``) does not occur in the demonstration text
    of the episode (substring test, as in the original)."""
    from ..functions.actions import formalize
    fa = formalize(F.col(action))
    typ = F.when(F.instr(fa, "(") > 0, F.substring_index(fa, "(", 1))
    s = steps.withColumn("_type", typ)
    if list(episode) == ["task_no"]:      # demonstrations of the 30 tasks
        demo_types = F.broadcast(demo_types)
    j = s.join(demo_types, list(episode), "inner")
    keep = (F.col(obs) != "N/A") & F.col("_type").isNotNull() & (F.instr(F.col(demo_text), F.col("_type")) > 0)
    return j.where(keep).drop("_type", demo_text)


def strip_col(c: str) -> Column:
    return py_strip(F.col(c))
