"""Sort, limit, top-k and seeded sampling.

Python's seeded shuffles cannot be replayed on Spark; the contract here is
"same sizes, same determinism": rows are ordered by
``md5(concat_ws('|', seed, key))``, which Spark and DuckDB compute
identically.  Per-group caps are ``row_number`` windows (no global sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .blocks import first_rows

#: Columns of ``sources.files.read_gold`` that tell the order of episodes in the corpus.
CORPUS_ORDER = ("source_file", "task_pos", "episode_pos")


def seeded_key(seed: int | str, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_int(seed: int | str, *cols: str) -> Column:
    """Deterministic non-negative int from the first 8 hex digits of the md5."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 8), 16, 10).cast("long")


def downsample(eps: DataFrame, rules: Sequence[tuple[str, int]] = tuple(fixed.DOWNSAMPLE_RULES), seed: int = 1,
               task: str = "task_real_id", key: str = "variation_id") -> DataFrame:
    """Tasks whose real id starts with a rule's prefix keep ``cap`` random
    episodes; others are unchanged.  Each rule is a ``row_number() <= cap``
    filter with a literal cap, which Spark plans as a per-partition
    ``WindowGroupLimit`` below the shuffle, so a huge task ships at most
    ``cap`` rows per partition."""
    out = None
    matched = F.lit(False)
    for prefix, n in rules:
        this = F.col(task).startswith(prefix) & ~matched
        matched = matched | F.col(task).startswith(prefix)
        w = Window.partitionBy(task).orderBy(seeded_key(seed, key), key)
        part = eps.where(this).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
        out = part if out is None else out.unionByName(part)
    rest = eps.where(~matched)
    return rest if out is None else out.unionByName(rest)


def mini(df: DataFrame, n: int, seed: int = 1, key: Sequence[str] = ("task_no", "variation_id", "step")) -> DataFrame:
    """``n`` random rows (seeded by ``key``, which must be unique): the first in the
    order of the seeded hash, found block by block (``first_rows``)."""
    return first_rows(df, n, [seeded_key(seed, *key).alias("_h"), *key])


def first_per_group(df: DataFrame, group: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """T2 per-group mini: first ``n`` rows per group in the given order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def pick_variations(eps: DataFrame, which: str, task: str = "task_no", key: str = "variation_id",
                    fold: str = "fold", seed: int = 1, test_cap: int = 50) -> DataFrame:
    """The evaluation variation policy by set name (numbers of any size).

    train: task 26 first 1/10, task 29 first 1/2, others all;
    test: at most ``test_cap`` random; dev: first 3; test_mini_2: rows 3..9;
    test_mini: first 3; test_mini_mini: first 1.  Unknown set -> ValueError.
    Fixed caps are literal ``row_number`` limits (``WindowGroupLimit``); the
    train fractions use a per-task count (partial aggregate) and a two-level
    running rank, so no task is ranked in one task."""
    if which not in ("train", "test", "dev", "test_mini_2", "test_mini", "test_mini_mini"):
        raise ValueError(f"unknown variation set {which!r}")
    base_fold = {"train": "train", "dev": "dev"}.get(which, "test")
    e = eps.where(F.col(fold) == base_fold)
    if which == "train":
        from .windows import blocked_running_sum
        n = e.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
        ranked = blocked_running_sum(e, [task], [key], {"_rn": F.lit(1).cast("long")})
        ranked = ranked.join(n, task)
        keep = (F.when(F.col(task) == 26, F.col("_rn") - 1 < F.floor(F.col("_n") / 10))
                .when(F.col(task) == 29, F.col("_rn") - 1 < F.floor(F.col("_n") / 2)).otherwise(F.lit(True)))
        return ranked.where(keep).drop("_rn", "_n")
    if which == "test":
        w = Window.partitionBy(task).orderBy(seeded_key(seed, key), key)
        return e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= test_cap).drop("_rn")
    w = Window.partitionBy(task).orderBy(key)
    r = e.withColumn("_rn", F.row_number().over(w))
    if which in ("dev", "test_mini"):
        r = r.where(F.col("_rn") <= 3)
    elif which == "test_mini_2":
        r = r.where((F.col("_rn") <= 10) & (F.col("_rn") >= 4))
    else:
        r = r.where(F.col("_rn") <= 1)
    return r.drop("_rn")


def first_variations(df: DataFrame, n: int = 10, task: str = "task_no", key: str = "variation_id") -> DataFrame:
    """T4: rows of the first ``n`` distinct variations per task (ascending)."""
    v = df.select(task, key).distinct()
    v = first_per_group(v, [task], n, [key])
    return df.join(v, [task, key], "left_semi")


def head(df: DataFrame, n: int, order: Sequence[str] = ("task_no", "variation_id", "step")) -> DataFrame:
    """T5: first ``n`` rows in an explicit total order (clamps when n > rows), found
    block by block (``first_rows``)."""
    return first_rows(df, n, order)


def cap_test_episodes(eps: DataFrame, cap: int = 10, task: str = "task_no", order: str | Sequence[str] = "variation_id",
                      fold: str = "fold") -> DataFrame:
    """Walking a task's episodes in corpus order, the ``cap``-th test
    episode ends the task: it and everything after it (any fold) is dropped.
    ``order`` is what tells the corpus order: of ``read_gold`` it is
    ``CORPUS_ORDER``.

    Keep rows whose running count of test episodes, including themselves,
    is below ``cap`` (once reached, every later row stays >= cap).  The
    running count goes over blocks of nearly equal depth, so a task with most of
    the corpus is not sorted in one task."""
    from .windows import blocked_running_sum
    t = F.when(F.col(fold) == "test", 1).otherwise(0).cast("long")
    r = blocked_running_sum(eps, [task], [order] if isinstance(order, str) else list(order), {"_tests": t})
    return r.where(F.col("_tests") < cap).drop("_tests")


def exemplars(eps_steps: DataFrame, n: int = 2, task: str = "task_no", key: str = "variation_id",
              step: str = "step", action: str = "action", order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` qualifying episodes of each task (input is F1+F2
    filtered steps) with their action path, joined ``a, b, `` (trailing
    comma, as in the prompts).  ``n_found`` < n flags tasks with too few.
    ``order`` tells the corpus order (``CORPUS_ORDER`` of ``read_gold``); without it
    the episodes' numbers do."""
    eps = eps_steps.select(task, key, *order).distinct()
    firsts = first_per_group(eps, [task], n, [*order, key])
    steps = eps_steps.join(firsts, [task, key], "left_semi")
    paths = steps.groupBy(task, key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(step, action))), lambda x: F.concat(x[action], F.lit(", "))), "").alias("path"))
    w = Window.partitionBy(task)
    return paths.withColumn("n_found", F.count(F.lit(1)).over(w))


def dense_index(values: DataFrame, col: str) -> DataFrame:
    """0-based index of every distinct value of ``col`` in the order of its hash
    (then the value).  Values lie in 4,096 blocks by their hash: rows of the blocks
    before plus the row number inside the block."""
    d = values.select(col).distinct().withColumn("_h", F.md5(F.col(col).cast("string")))
    d = d.withColumn("_b", F.substring("_h", 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)      # at most 4,096 rows
    ahead = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_a"))
    inside = Window.partitionBy("_b").orderBy("_h", col)
    return d.join(F.broadcast(ahead), "_b").select(col, (F.col("_a") + F.row_number().over(inside) - 1).alias("index"))


def inject_random(steps: DataFrame, vocab: DataFrame, every: int = 10, seed: int = 1,
                  keys: Sequence[str] = ("task_no", "variation_id"), step: str = "step", col: str = "subgoal") -> DataFrame:
    """Every ``every``-th step replaces its sub-goal by a vocabulary entry
    picked by a seeded hash.  The vocabulary is ranked once and joined on the
    picked rank (AQE broadcasts it when its runtime size is small).  The
    ranking is distributed (``dense_index``)."""
    v = dense_index(vocab.select(F.col(col).alias("_v")), "_v").withColumnRenamed("index", "_vr")
    nv = v.agg(F.count(F.lit(1)).alias("_nv"))
    pick = F.pmod(seeded_int(seed, *keys, step), F.col("_nv"))
    # one-row side: joined on a constant key and broadcast
    s = steps.withColumn("_one", F.lit(1)).join(F.broadcast(nv.withColumn("_one", F.lit(1))), "_one").drop("_one")
    s = s.withColumn("_pick", F.when(F.col(step) % every == 0, pick))
    j = s.join(v, s["_pick"] == v["_vr"], "left")
    return j.withColumn(col, F.coalesce(F.col("_v"), F.col(col))).drop("_v", "_vr", "_pick", "_nv")
