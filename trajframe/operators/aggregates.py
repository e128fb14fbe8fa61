"""Aggregations (A1-A12) and the U4 set aggregate.

All are ``groupBy`` aggregates, so Spark does a map-side partial aggregate
before the shuffle: a key holding a third of the rows still ships one partial
row per task.  Pivots list their values explicitly (no extra job to find
them)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_word, py_strip
from .filters import failed_col

FOLDS = ["train", "dev", "test"]


def count_by_fold(df: DataFrame, key: str = "task_no", fold: str = "fold") -> DataFrame:
    """A1/A2: rows per key x fold, zeros present."""
    return df.groupBy(key).pivot(fold, FOLDS).count().fillna(0, subset=FOLDS)


def task_distribution(ex: DataFrame, key: str = "task_real_id") -> DataFrame:
    """A3: examples per real task id, most first (ties by id)."""
    return ex.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def verb_distribution(ex: DataFrame, label: str = "target") -> DataFrame:
    """A4: first whitespace token of the label, counted, most first."""
    return (ex.select(first_word(label).alias("verb")).groupBy("verb")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "verb"))


def split_coverage(ex: DataFrame, group: str = "task_group", split: str = "fold") -> DataFrame:
    """A5: per task group, the splits it appears in; ``complete`` is false for
    groups missing from any of train/dev/test (the original asserts equal
    group counts across splits)."""
    g = ex.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("_s"))
    return g.select(group, F.array_join("_s", ",").alias("splits"),
                    (F.size("_s") == len(FOLDS)).alias("complete"))


def mean_scores(finals: DataFrame, key: str = "task_no", score: str = "final_score") -> DataFrame:
    """Mean final episode score per task."""
    return finals.groupBy(key).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("episodes"))


def normalise_subgoal(c) -> F.Column:
    """Sub-goal comparison form: newline/tab -> space, strip, strip ``.``."""
    from ..functions.text import clean_ws
    return py_strip(py_strip(clean_ws(c)), ".")


def exact_match(pairs: DataFrame, key: str = "task_no", pred: str = "prediction", target: str = "target",
                normalise: bool = False) -> DataFrame:
    """100 * matches / rows per key; the sub-goal variant normalises both
    sides first, the action variant compares raw text."""
    p, t = F.col(pred), F.col(target)
    if normalise:
        p, t = normalise_subgoal(p), normalise_subgoal(t)
    return pairs.groupBy(key).agg((F.avg(F.when(p == t, 1.0).otherwise(0.0)) * 100).alias("exact_match"),
                                  F.count(F.lit(1)).alias("rows"))


def _ngrams(tokens: F.Column, n: int) -> F.Column:
    idx = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n,
                  F.transform(idx, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))).otherwise(
        F.array().cast("array<string>"))


def corpus_bleu(pairs: DataFrame, pred: str = "prediction", target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU (0..100, 4 decimals) of prediction vs one reference.

    Our tokenisation: both sides stripped and split on whitespace.  Clipped
    n-gram matches for n = 1..4 are counted inside each row by array functions
    and only their sums are aggregated, so no n-gram is shuffled and rows need no
    key.  Combined with the brevity penalty and the exponential smoothing for
    zero-match orders.  This is a stated re-implementation, not a claim of
    equality with an external scorer."""
    words = lambda c: F.filter(F.split(py_strip(F.col(c)), r"\s+"), lambda x: x != "")
    toks = pairs.select(*keys, F.coalesce(words(pred), F.array().cast("array<string>")).alias("_h"),
                        F.coalesce(words(target), F.array().cast("array<string>")).alias("_r"))
    for n in range(1, 5):
        toks = toks.withColumn(f"_h{n}", _ngrams(F.col("_h"), n)).withColumn(f"_r{n}", _ngrams(F.col("_r"), n))

    def clipped(n: int) -> F.Column:
        times = lambda side, g: F.size(F.filter(f"{side}{n}", lambda x: x == g))
        return F.aggregate(F.array_intersect(f"_h{n}", f"_r{n}"), F.lit(0), lambda s, g: s + F.least(times("_h", g), times("_r", g)))

    stats = toks.groupBy(*keys).agg(
        *[F.coalesce(F.sum(clipped(n)), F.lit(0)).alias(f"m{n}") for n in range(1, 5)],
        *[F.coalesce(F.sum(F.size(f"_h{n}")), F.lit(0)).alias(f"t{n}") for n in range(1, 5)],
        F.coalesce(F.sum(F.size("_h")), F.lit(0)).alias("hyp_len"), F.coalesce(F.sum(F.size("_r")), F.lit(0)).alias("ref_len"))
    return stats.select(*keys, bleu_expr().alias("bleu"), "hyp_len", "ref_len")


def bleu_expr() -> F.Column:
    """Closed form over the m1..m4 / t1..t4 / hyp_len / ref_len columns."""
    logs = []
    for n in range(1, 5):
        m, t = F.col(f"m{n}").cast("double"), F.col(f"t{n}").cast("double")
        # exp smoothing: each zero-match order doubles the denominator factor
        zeros_so_far = sum((F.when(F.col(f"m{j}") == 0, 1).otherwise(0) for j in range(1, n + 1)), F.lit(0))
        p = F.when(t == 0, F.lit(None)).when(m > 0, m / t).otherwise(F.lit(1.0) / (F.pow(F.lit(2.0), zeros_so_far) * t))
        logs.append(F.log(p))
    mean_log = (logs[0] + logs[1] + logs[2] + logs[3]) / 4
    hyp, ref = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    bp = F.when(hyp == 0, F.lit(0.0)).when(hyp < ref, F.exp(F.lit(1.0) - ref / hyp)).otherwise(F.lit(1.0))
    return F.round(F.coalesce(bp * F.exp(mean_log) * 100, F.lit(0.0)), 4)


def generation_stats(pairs: DataFrame, pred: str = "prediction", target: str = "target") -> DataFrame:
    """Mean generated length (whitespace tokens of the stripped
    prediction) and mean exact match, both rounded to 4."""
    p = py_strip(F.col(pred))
    t = py_strip(F.col(target))
    n = F.size(F.filter(F.split(p, r"\s+"), lambda x: x != ""))
    return pairs.agg(F.round(F.avg(n), 4).alias("gen_len"),
                     F.round(F.avg(F.when(p == t, 1.0).otherwise(0.0)), 4).alias("exact_match"))


def subgoal_vocab(steps: DataFrame, col: str = "subgoal") -> DataFrame:
    """A10: distinct sub-goal vocabulary."""
    return steps.select(col).where(F.col(col).isNotNull()).distinct()


def sample_counts(ex: DataFrame, caps: dict[str, int], split: str = "fold") -> DataFrame:
    """Effective sample count = min(cap, rows) per split."""
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    return (ex.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("samples", F.least(F.col("rows"), F.coalesce(cap[F.col(split)], F.col("rows")))))


def failure_messages(steps: DataFrame, keys: Sequence[str] = ("task_no", "variation_id"), obs: str = "observation") -> DataFrame:
    """U4: distinct failure messages per episode, sorted."""
    f = steps.where(failed_col(obs))
    return f.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(obs)), " || ").alias("messages"),
                               F.count(F.lit(1)).alias("failures"))
