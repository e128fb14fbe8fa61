"""Operator 8, exact top-k by inner product over norm-sorted vectors.

Vectors are integers, ``floor(64 x)``.  Candidates are dealt by descending length
to ranges and inside a range to cells of about ``CELL`` rows; queries to groups of
about ``GROUP`` rows.  The ``SEEDS`` longest vectors (a fixed number, so they are
broadcast) give every query a first bound, the k-th best score among them; a query
is sent only to cells whose longest vector can still reach it.  In a cell the
candidates go by descending length.  Queries and candidates are rotated by the
singular vectors of all vectors, so the first ``HEAD`` coordinates hold most of a
product; their partial sum plus the Cauchy-Schwarz bound of the rest prunes, the
exact integer product is taken of what is left, and the bound rises as scores are
found.  Every cell returns its best k for each query, merged at the end.

Defined cases: vectors that are null or hold null or non-finite components take
no part, neither do those whose squared length, 64 times the components, reaches
2**62, as their products need not fit 64 bits, nor rows without ``vec_id``; an empty vector or a missing component
counts as zero; rows that repeat a ``vec_id`` count once (their least vector)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, vectors_of

K, EVERY, FACTOR = 20, 20, 64
#: Least squared length that is left out: products of two shorter vectors fit 64 bits (Cauchy-Schwarz).
MOST = 2.0**62
SEEDS, RANGES, CELL, GROUP, STRIP, HEAD = 2048, 64, 16384, 4096, 1024, 24


def _integers(width: int):
    def run(batches):
        for batch in batches:
            x, good = vectors_of(batch.column("embedding"), width)
            whole = np.floor(FACTOR * x)
            good &= (whole ** 2).sum(1) < MOST
            ints = whole[good].astype(np.int64)
            length = np.sqrt((ints.astype(float) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), pa.array(list(ints), pa.list_(pa.int64())), pa.array(length)],
                                             ["vec_id", "v", "length"])
    return run


def _gram(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(float)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "x"])
    return run


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of rows; by floating point where that is exact."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def _first_bounds(seeds, k: int):
    def run(batches):
        ids, v = seeds.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("vec_id").to_numpy()
            bound = np.full(len(own), -np.inf)
            if len(ids) > k:
                score = exact(np.stack(batch.column("v").to_numpy(zero_copy_only=False)), v).astype(float)
                score[own[:, None] == ids[None, :]] = -np.inf
                bound = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], [*batch.schema.names, "bound"])
    return run


def best(q_id, q, bound, c_id, c, rotate, k: int):
    """``(query, score, id)`` arrays of the best k candidates of each query."""
    order = np.lexsort((c_id, -(c.astype(float) ** 2).sum(1)))
    c_id, c = c_id[order], c[order]
    qr, cr = q @ rotate, c @ rotate
    slack = 1e-9 * (1 + np.abs(qr).sum(1).max(initial=0) * np.abs(cr).max(initial=0))
    length = lambda x: np.sqrt((x * x).sum(1))
    q_all, c_all, q_rest, c_rest = length(qr), length(cr), length(qr[:, HEAD:]), length(cr[:, HEAD:])
    bound = bound.copy()
    found = [np.zeros(0, np.int64)] * 3
    for a in range(0, len(c), STRIP):
        live = np.flatnonzero(q_all * c_all[a] + slack >= bound)
        if not len(live):
            break
        s = slice(a, a + STRIP)
        most = qr[live, :HEAD] @ cr[s, :HEAD].T + q_rest[live, None] * c_rest[None, s] + slack
        may = (most >= bound[live, None]) & (q_id[live, None] != c_id[None, s])
        rows, columns = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(rows):
            continue
        score = exact(q[live[rows]], c[s][columns])
        i, j = np.nonzero(may[np.ix_(rows, columns)] & (score >= bound[live[rows], None]))
        found = [np.concatenate(x) for x in zip(found, (live[rows][i], score[i, j], c_id[s][columns][j]))]
        order = np.lexsort((found[2], -found[1], found[0]))
        found = [x[order] for x in found]
        first = np.searchsorted(found[0], found[0], "left")
        keep = np.arange(len(first)) - first < k
        found = [x[keep] for x in found]
        n = np.bincount(found[0], minlength=len(q))
        full = np.flatnonzero(n >= k)
        last = np.cumsum(n)[full] - 1
        bound[full] = np.maximum(bound[full], found[1][last])
    return found


def _cell(rotate, k: int):
    def run(_key, queries, candidates):
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, c = np.stack(queries["v"].to_numpy()), np.stack(candidates["v"].to_numpy())
        ids = queries["vec_id"].to_numpy()
        row, score, vec = best(ids, q, queries["bound"].to_numpy(), candidates["vec_id"].to_numpy(), c, rotate.value, k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": vec, "score": score})
    return run


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = max(vectors.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)
    rows = cut(vectors.mapInArrow(_integers(width), "vec_id long, v array<long>, length double")
               .groupBy("vec_id").agg(F.min(F.struct("v", "length")).alias("_m")).select("vec_id", "_m.v", "_m.length"), "vectors")
    n, queries_n = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()

    # width * width sums, SEEDS vectors and RANGES bounds reach the driver, whatever the input
    gram = np.zeros(width * width)
    for at, x in rows.mapInArrow(_gram(width), "at long, x double").groupBy("at").agg(F.sum("x")).collect():
        gram[at] = x
    rotate = spark.sparkContext.broadcast(np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy())
    top = rows.orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "v").collect()
    seeds = spark.sparkContext.broadcast((np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.int64).reshape(len(top), width)))

    parts = max(1, min(RANGES, -(-n // CELL)))
    ends = sorted(set(rows.approxQuantile("length", [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []
    of_range = sum((F.when(F.col("length") >= x, 1).otherwise(0) for x in ends), F.lit(0))
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy(of_range.alias("r")).agg(F.count(F.lit(1)), F.max("length")).collect()}
    split = [max(1, -(-sizes.get(r, (0, 0))[0] // CELL)) for r in range(len(ends) + 1)]
    before = [sum(split[:r]) for r in range(len(split))]
    pick = lambda values, r: F.element_at(F.array(*map(F.lit, values)), r + 1)
    placed = rows.withColumn("_r", of_range).withColumn("cell", (pick(before, F.col("_r")) + F.pmod(F.xxhash64("vec_id"), pick(split, F.col("_r")))).cast("int"))
    groups = max(1, -(-queries_n // GROUP))

    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(_first_bounds(seeds, k), "vec_id long, v array<long>, length double, bound double")
    reach = F.array(*(F.struct(F.lit(b).alias("first"), F.lit(b + split[r] - 1).alias("last"), F.lit(float(sizes.get(r, (0, 0.0))[1])).alias("longest"))
                      for r, b in enumerate(before)))
    asked = (asked.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(groups)).cast("int"))
             .withColumn("_c", F.explode(F.filter(reach, lambda c: c["longest"] * F.col("length") * (1 + 1e-9) >= F.col("bound"))))
             .withColumn("cell", F.explode(F.sequence("_c.first", "_c.last"))).select("group", "cell", "vec_id", "v", "bound"))
    # a candidate goes to the groups that ask its cell, to no other
    asking = asked.select(F.col("group").alias("_group"), F.col("cell").alias("_cell")).distinct()
    offered = placed.join(asking, F.col("cell") == F.col("_cell")).select(F.col("_group").alias("group"), F.col("_cell").alias("cell"), "vec_id", "v")
    found = asked.groupBy("group", "cell").cogroup(offered.groupBy("group", "cell")).applyInPandas(_cell(rotate, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
