"""Operator 2, near-duplicate vectors by lattice hashing.

In each of ``TABLES`` tables a unit vector is projected to eight dimensions and
decoded to the nearest point of the E8 lattice, its home cell; it also probes the
``PROBES`` neighbouring cells nearest to it.  Two vectors are candidates when the
home of one is the home of, or probed by, the other.  Candidates whose 128 random
signs differ in more than ``SIGNS`` places are dropped (at cosine 0.9 that is over
five standard deviations away); the others are verified by the cosine in double
precision.  At cosine 0.9 a table finds a pair with a chance of about 0.53, so eight find
0.997 of such pairs (measured; more for closer ones).

Equal vectors are one class and only one of them is compared.  Cells are cut into
blocks of bounded size, so a hot cell is spread over many tasks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; shorter vectors are filled up with zeros; rows
that repeat a ``vec_id`` are one vector as far as components go; a null
``vec_id`` is linked only to equal vectors."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, cut, discard, mix, pairs_in_groups, vectors_of, whole_groups

COSINE = 0.9
TABLES, PROBES, SCALE, SIGNS = 8, 8, 0.8, 40
BLOCK = 2048


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two unit steps, or eight half steps with an even number of minuses."""
    steps = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            steps.append(v)
    halves = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(steps + [np.array(v) for v in halves])


NEIGHBOURS = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and if the sum is odd round
    the coordinate with the largest error the other way."""
    point = np.rint(x)
    error = x - point
    row = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(error[row]).argmax(1)
    point[row, worst] += np.where(error[row, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    total = np.full(points.shape[:-1], table + 1, np.uint64)
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for k in range(8):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + doubled[..., k])
    return total.view(np.int64)


def projections(width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.normal(size=(TABLES, width, 8)) * SCALE, rng.normal(size=(width, 128))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    most = np.abs(x).max(1, initial=0)
    x = x / np.where(most > 0, most, 1)[:, None]
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def _features(width: int):
    def run(batches):
        for batch in batches:
            x, good = vectors_of(batch.column("embedding"), width)
            good &= (x != 0).any(1)
            x += 0.0                                  # -0.0 and 0.0 are equal
            sig = [xxhash.xxh3_128_digest(v.tobytes()) if g else None for v, g in zip(x, good)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sig, pa.binary()),
                                              pa.array([v if g else None for v, g in zip(unit(x), good)], pa.list_(pa.float64()))], ["vec_id", "sig", "unit"])
    return run


def _cells(width: int):
    project, signs = projections(width)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            x = np.stack(batch.column("unit").to_numpy(zero_copy_only=False))
            bits = np.packbits(x @ signs > 0, axis=1).view(np.int64)
            out = []
            for t in range(TABLES):
                y = x @ project[t]
                home = nearest_e8(y)
                near = np.argpartition(-((y - home) @ NEIGHBOURS.T), PROBES - 1, axis=1)[:, :PROBES]
                out.append(np.concatenate([cell_keys(home, t)[:, None], cell_keys(home[:, None, :] + NEIGHBOURS[near], t)], 1))
            keys = np.concatenate(out, 1)
            n, per = keys.shape
            home = np.tile(np.arange(per) % (PROBES + 1) == 0, n)
            repeat = lambda a: pa.array(np.repeat(a, per))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), repeat(ids), pa.array(home), repeat(bits[:, 0].copy()), repeat(bits[:, 1].copy())],
                                             ["key", "vec_id", "home", "s0", "s1"])
    return run


def _candidates(batches):
    for table in whole_groups(batches, ["key", "bi", "bj"]):
        key, bi, bj, ids, side, home, s0, s1 = (table.column(c).to_numpy() for c in ("key", "bi", "bj", "vec_id", "side", "home", "s0", "s1"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        new = np.r_[True, (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]
        a, b = [], []
        for i, j in pairs_in_groups(new):
            ok = (home[i] | home[j]) & ((bi[i] == bj[i]) | (side[i] != side[j])) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(s0[i] ^ s0[j]).astype(int) + np.bitwise_count(s1[i] ^ s1[j]) <= SIGNS
            a.append(ids[i[ok]]), b.append(ids[j[ok]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _verified(cosine: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                u, v = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("u", "v"))
                batch = batch.filter(pa.array((u * v).sum(1) >= cosine))
            yield batch.select(["a", "b"])
    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    width = max(width or 1, 1)
    features = cut(vectors.mapInArrow(_features(width), "vec_id long, sig binary, unit array<double>"), "vectors")
    narrow = features.select("vec_id", "sig")
    classes = narrow.where("sig is not null").groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    named = classes.where("rep is not null")
    reps = cut(features.join(named.select(F.col("rep").alias("vec_id"), "sig"), ["vec_id", "sig"], "left_semi")
               .dropDuplicates(["vec_id", "sig"]).select("vec_id", "unit"), "representatives")

    cells = cut(reps.mapInArrow(_cells(width), "key long, vec_id long, home boolean, s0 long, s1 long"), "cells")
    shared = (cells.groupBy("key").agg(F.max("home").alias("_home"), F.min("vec_id").alias("_a"), F.max("vec_id").alias("_b"))
              .where("_home and _a < _b").select("key"))
    dealt = blocks(cells.join(shared, "key"), "key", "vec_id", BLOCK)
    found = (dealt.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
             .mapInArrow(_candidates, "a long, b long").distinct())
    links = cut(found.join(reps.select(F.col("vec_id").alias("a"), F.col("unit").alias("u")), "a")
                .join(reps.select(F.col("vec_id").alias("b"), F.col("unit").alias("v")), "b")
                .select("a", "b", "u", "v").mapInArrow(_verified(cosine), "a long, b long").distinct(), "links")
    discard(cells)
    joined = components(links)

    copies = named.groupBy(F.col("rep").alias("b")).agg(F.sum("copies").alias("copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("other"))
    of_class = (classes.join(counted, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
                .select("sig", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    valid = narrow.where("sig is not null").join(of_class, "sig").select("vec_id", "n_links", "component_id")
    rest = narrow.where("sig is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
      where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
u as (select * from g where n > 0),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id
      where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r as (with recursive t(a, b) as (select vec_id, vec_id from embeddings union select t.a, l.b from t join l on t.b = l.a) select a, min(b) as c from t group by a)
select e.vec_id, coalesce(k.n, 0)::bigint as n_links, r.c as component_id, e.vec_id = r.c as kept
from embeddings e join r on r.a = e.vec_id left join (select a, count(*) as n from l group by a) k on k.a = e.vec_id
"""
