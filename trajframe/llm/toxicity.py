"""Operator 6, toxic passages as maximum-scoring segments.

Learning.  From a bounded sample of labelled documents (``SAMPLE`` rows a class,
in hash order of the id) the documents of each class that hold a feature are
counted.  A class that the bound cuts counts with the weight of all its labelled
documents, so the share of toxic ones and the calibration are those of all labels.  A feature is a word or one of its prefixes.  Its log-odds of the toxic
class are taken with a Dirichlet (for two classes: beta) prior centred on its
longest kept prefix, so an unseen inflection falls back to its stem and a rare
word to the base rate.  The ``FEATURES`` most significant features are kept.

Scoring.  A text is a sequence of token log-odds less ``DRIFT``; a linear scan
keeps every maximal segment (no segment can be extended or split to a higher
sum).  The best segment of a text of n tokens follows an extreme-value law among
clean texts, ``P(S > s) = 1 - exp(-E(s))`` with ``E(s) = K (n + EDGE) exp(-lambda
s)``; lambda and K are fitted on clean sample texts, each scored without the
counts of its own fold.  A segment is a passage when its expected number is at
most ``EXPECTED``.  All segments of a text are aggregated by the same law: ``r``
segments of at least ``s`` have a chance of about ``E(s)^r / r!``; the least such
chance over all ranks is the evidence, calibrated to a probability by a logistic
fit on the same cross-scored texts.

Defined cases: null and empty texts have no passage and get the score of
no evidence; null ``doc_id`` and null ``toxic`` are never learned from; a document
labelled several times counts once, toxic if any label says so; without labels
of both classes every score is the share of toxic labels (0 without labels)."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes

#: Labelled rows that are learned from, at most this many a class (hash order of the id).
SAMPLE = 20_000
#: Features that the model keeps, at most (the most significant ones).
FEATURES = 100_000
#: Features in fewer sampled documents than this fall back to their prefix.
LEAST_DOCS = 3
PRIOR, DRIFT, EXPECTED = 12.0, 2.0, 0.01
#: Words added to a text's length, for the law does not hold in very short texts.
EDGE = 100
PREFIXES = (3, 4, 5, 6)
FOLDS = 5
_EDGE = re.compile(r"^\W+|\W+$")

PASSAGES = "array<struct<start:int,end:int,score:double>>"


def fold(column) -> F.Column:
    return F.crc32(F.col(column).cast("string")) % FOLDS


def normal(raw: bytes) -> str:
    return _EDGE.sub("", raw.decode("utf-8", "replace").lower())


def features_of(word: str) -> list[str]:
    """From the shortest prefix to the word itself (marked by a final blank)."""
    return [word[:n] for n in PREFIXES if n < len(word)] + [word + " "]


def _counts(batches):
    for batch in batches:
        total: dict[str, list[int]] = {}
        for text, k, y in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))):
            own = set()
            for raw in set(text_bytes(text).split()):
                if word := normal(raw):
                    own.update(features_of(word))
            at = 2 * k + y
            for f in own:
                total.setdefault(f, [0] * (2 * FOLDS))[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.int64()))], ["feature", "n"])


class Scores(dict):
    """Token log-odds by raw word, looked up once a word; emptied when large."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model

    def __missing__(self, raw: bytes) -> float:
        value, word = 0.0, normal(raw)
        for f in reversed(features_of(word)) if word else ():
            if (got := self.model.get(f)) is not None:
                value = got
                break
        if len(self) > 400_000:
            self.clear()
        self[raw] = value
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, sum)``, end exclusive, in one
    pass: candidates are kept with the cumulative sums at both ends and merged
    with the nearest earlier one that starts lower."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []          # start, end, sum before, sum after, index of the nearest candidate that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        item = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                found.append(item + [j])
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(a, b, float(d - c)) for a, b, c, d, _ in found]


def odds(feature_counts: dict[str, tuple[float, float]], share: float) -> dict[str, float]:
    """Log-odds against the base rate, each with a prior centred on the longest kept prefix."""
    rate: dict[str, float] = {}
    base = math.log(share / (1 - share))
    for f in sorted(feature_counts, key=lambda x: (x.endswith(" "), len(x))):
        clean, toxic = feature_counts[f]
        centre = share
        for n in reversed(PREFIXES):
            if n < len(f.rstrip(" ")) and f[:n] in rate:
                centre = rate[f[:n]]
                break
        rate[f] = (toxic + PRIOR * centre) / (clean + toxic + PRIOR)
    return {f: math.log(r / (1 - r)) - base for f, r in rate.items()}


def best(text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    words = text_bytes(text).split()
    return len(words), segments(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)) - DRIFT) if words else []


def _cross(models):
    """Length and segment scores of sample texts, without the counts of their fold."""
    def run(batches):
        scores = {k: Scores(m) for k, m in models.value.items()}
        for batch in batches:
            n, sums = [], []
            for text, k in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist()):
                size, found = best(text, scores[k])
                n.append(size), sums.append([s for *_, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64())), batch.column("toxic")], ["n", "sums", "toxic"])
    return run


def extreme_law(words: float, found: int, total: float) -> tuple[float, float]:
    """``lambda, ln K`` of clean texts, from their words (each with ``EDGE`` more), the
    number of their segments and the sum of these: segments above s come at a rate of
    ``K exp(-lambda s)`` a word, so the best of a text follows a Gumbel law."""
    return min(max((found + 1) / (total + 1), 0.25), 4.0), math.log((found + 1) / (words or 1.0))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton steps."""
    weight = np.broadcast_to(weight, len(x))
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(float(w[0]), 0.0) / scale
    return slope, float(w[1]) - slope * float(x.mean())


def evidence(rate: float, log_k: float, n: int, sums: list[float]) -> float:
    """Minus the logarithm of the least chance of as many segments as good, over all ranks."""
    most, log_n = 0.0, log_k + math.log(n + EDGE)
    for r, s in enumerate(sorted(sums, reverse=True), 1):
        most = max(most, r * (rate * s - log_n) + math.lgamma(r + 1))
    return most


def _evidence(rate: float, log_k: float):
    def run(batches):
        for batch in batches:
            x = [evidence(rate, log_k, n, s) for n, s in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic")], ["x", "toxic"])
    return run


def class_weights(labelled: np.ndarray) -> np.ndarray:
    """Weights of sampled rows by class (clean, toxic) that restore the ratio of all
    labelled documents; the lesser is 1, so priors keep their strength at every size."""
    weight = np.maximum(labelled / SAMPLE, 1.0)
    return weight / weight.min()


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learn the model; what reaches the driver is bounded by SAMPLE and FEATURES."""
    spark = docs.sparkSession
    known = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("fold", fold("doc_id").cast("int")).where("fold <> 0"))
    labelled = np.zeros(2)
    for y, n in known.groupBy("toxic").count().collect():
        labelled[y] = n
    weight = class_weights(labelled)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE))
    # at most 2 * SAMPLE rows of three numbers
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
                 .select("text", "fold", "toxic"), "sample")
    sizes = np.zeros((FOLDS, 2))
    for k, y, n in sample.groupBy("fold", "toxic").count().collect():
        sizes[k, y] = n
    clean, toxic = sizes.sum(0)
    if not clean or not toxic:
        return {"share": float(toxic / max(clean + toxic, 1)), "models": None}
    # features are chosen by the sample as it is, everything learned from them is weighted
    share = float(toxic / (clean + toxic))
    counted = sample.mapInArrow(_counts, "feature string, n array<long>").select("feature", *(F.col("n")[i].alias(f"n{i}") for i in range(2 * FOLDS)))
    counted = counted.groupBy("feature").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(2 * FOLDS)))
    of = lambda y: sum((F.col(f"n{2 * k + y}") for k in range(1, FOLDS)), F.lit(0))
    counted = counted.withColumn("_n", of(0) + of(1)).where(F.col("_n") >= LEAST_DOCS)
    z = F.abs(of(1) - F.col("_n") * share) / F.sqrt(F.col("_n") * (share * (1 - share)))
    kept = counted.withColumn("_z", z).where("_z >= 1.5").orderBy(F.desc("_z"), "feature").limit(FEATURES).drop("_z", "_n").collect()
    names = [r[0] for r in kept]
    n = np.array([r[1:] for r in kept], dtype=float).reshape(-1, FOLDS, 2)
    models = {}
    for k in range(FOLDS):
        use = [i for i in range(1, FOLDS) if i != k]
        c = n[:, use].sum(1) * weight
        own = sizes[use].sum(0) * weight
        models[k] = odds(dict(zip(names, c)), float(min(max(own[1], 0.5), own.sum() - 0.5) / own.sum()))
    shared = spark.sparkContext.broadcast(models)
    seen = cut(sample.mapInArrow(_cross(shared), "n long, sums array<double>, toxic int"), "seen")
    # exact sums, so that reruns agree
    total = F.aggregate("sums", F.lit(0.0), lambda a, b: a + b).cast("decimal(28,12)")
    words, found, total = seen.where("toxic = 0").agg(F.sum(F.col("n") + EDGE), F.sum(F.size("sums")), F.sum(total)).first()
    rate, log_k = extreme_law(float(words or 0), int(found or 0), float(total or 0))
    # one number and the class of at most 2 * SAMPLE texts
    tested = seen.mapInArrow(_evidence(rate, log_k), "x double, toxic int").toPandas()
    y = tested["toxic"].to_numpy()
    slope, intercept = logistic(tested["x"].to_numpy(float), y.astype(float), weight=weight[y])
    share = float(toxic * weight[1] / (clean * weight[0] + toxic * weight[1]))
    return {"share": share, "models": models[0], "rate": rate, "log_k": log_k, "slope": slope, "intercept": intercept}


def _score(model):
    def run(batches):
        m = model.value
        scores = Scores(m["models"]) if m["models"] is not None else None
        for batch in batches:
            out, passages = [], []
            for text in batch.column("text").to_pylist():
                if scores is None:
                    out.append(m["share"]), passages.append([])
                    continue
                n, found = best(text, scores)
                x = evidence(m["rate"], m["log_k"], n, [s for *_, s in found])
                out.append(float(1 / (1 + np.exp(-np.clip(m["slope"] * x + m["intercept"], -35, 35)))))
                least = math.log((n + EDGE) / EXPECTED) + m["log_k"]
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in found if m["rate"] * s >= least])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64()), pa.array(passages, kind)], [*batch.schema.names, "_score", "_passages"])
    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``_score`` and ``_passages`` (token spans); one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", _score double, _passages {PASSAGES}"
    return docs.mapInArrow(_score(shared), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted, passages``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_passages").alias("passages"))
