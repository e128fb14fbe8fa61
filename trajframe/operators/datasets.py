"""Training sets from steps in one call (C16): choice of episodes, annotation,
composition and files by split, task and group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources import sinks as K
from ..sources.tables import task_dimension
from . import sampling as T
from .annotate import annotate
from .compose import RECIPES, compose, compose_first_subgoal

EPISODE = ("task_no", "variation_id")
RECIPE_NAMES = ("action_sg", "subgoal", "first_subgoal", "action_formal")


def chosen_steps(steps: DataFrame, rules=None, min_len: int = 2, test_cap: int = 10, episode: Sequence[str] = EPISODE, seed: int = 1,
                 order: str | Sequence[str] = "variation_id") -> DataFrame:
    """The steps of the episodes that a training set takes: T1 (``rules``, by
    task_real_id), F2, then W13 in the order of the corpus."""
    extra = [order] if isinstance(order, str) else list(order)
    eps = steps.groupBy(*dict.fromkeys([*episode, "fold", "task_real_id", *extra])).agg(F.count(F.lit(1)).alias("_n"))
    eps = T.downsample(eps, rules, seed) if rules else T.downsample(eps, seed=seed)
    eps = T.cap_test_episodes(eps.where(F.col("_n") >= min_len), test_cap, order=order)
    return steps.join(eps.select(*episode), list(episode), "left_semi")


def composed(steps: DataFrame, recipe: str, episode: Sequence[str] = EPISODE) -> DataFrame:
    """Examples of one recipe: ``action_sg`` (C1), ``subgoal`` (C2), ``first_subgoal`` (C10),
    ``action_formal`` (the set without sub-goals)."""
    return compose_first_subgoal(steps, episode) if recipe == "first_subgoal" else compose(steps, RECIPES[recipe], episode)


def build_dataset(steps: DataFrame, recipe: str, **choice) -> DataFrame:
    """The example pipeline of one training set."""
    return composed(chosen_steps(steps, **choice), recipe, choice.get("episode", EPISODE))


def write_dataset(spark: SparkSession, steps: DataFrame, path: str, recipes: Sequence[str] = RECIPE_NAMES, **choice) -> None:
    """C16 with K1: every recipe's examples under ``path/<recipe>``, by split and task."""
    dim = F.broadcast(task_dimension(spark).select("task_no", "task_real_id"))
    steps = cut(steps, "dataset-steps")          # every recipe reads it
    for r in recipes:
        K.write_examples(build_dataset(steps, r, **choice).join(dim, "task_no"), f"{path}/{r}")


def write_annotated_dataset(spark: SparkSession, steps: DataFrame, path: str, cache: DataFrame, answer_fn: Callable[[DataFrame], DataFrame],
                            gap_fn: Callable[[DataFrame], DataFrame] | None = None, recipes: Sequence[str] = RECIPE_NAMES,
                            mini_n: int = 2000, **choice) -> None:
    """From steps to training files in one call: the episodes are chosen, annotated
    (L7: cached answers, ``answer_fn`` for the others, ``gap_fn`` for gaps) and marked,
    and every recipe is written by split and task (``<recipe>/tasks``, K1) and by
    group with its mini validation split (``<recipe>/groups``, K2).  New answers
    (``answers``) and the report of steps without sub-goal (``report``) are written too."""
    keys = list(choice.get("episode", EPISODE))
    labelled, fresh, report = annotate(chosen_steps(steps, **choice), cache, answer_fn, gap_fn, keys)
    labelled = cut(labelled.drop("source", "is_marker"), "dataset-labelled")
    fresh.write.mode("overwrite").parquet(f"{path}/answers")
    report.write.mode("overwrite").parquet(f"{path}/report")
    dim = F.broadcast(task_dimension(spark).select("task_no", "task_real_id", "task_group"))
    for r in recipes:
        examples = composed(labelled, r, keys)
        examples = examples if "step" in examples.columns else examples.withColumn("step", F.lit(0))
        examples = cut(examples.drop("task_real_id", "task_group").join(dim, "task_no").withColumn("task_id", F.col("task_no").cast("int")), "examples")
        K.write_examples(examples.drop("task_group"), f"{path}/{r}/tasks")
        K.write_groups(examples.drop("task_real_id"), f"{path}/{r}/groups", mini_n=mini_n)
