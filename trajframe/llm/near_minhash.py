"""Operator 5, MinHash near-duplicates verified through odd sketches.

A document's set holds its distinct five-word shingles (the whole sequence when
it has fewer words).  ``K`` MinHash samples of the set are folded into a parity
bitmap of ``BITS`` bits (an odd sketch); the first ``BANDS * ROWS`` samples are
also banded.  Documents that share a band are candidates; the population count
of the XOR of two sketches estimates the number of differing samples precisely
for similar sets, and prunes candidates far below the threshold; what is left
is confirmed on the full sets.

* Documents with equal sets are one class; only one of a class is compared.
* A band's smallest member is compared with all others first (as many pairs as
  members).  Where a band then holds several components, its largest is dealt to
  blocks, and only the rows outside it are repeated, to meet its blocks and each
  other.  Inside a block pairs of different components are compared in the first
  band that both share and give a row only when they join two components, so a
  group of near copies is never expanded into all pairs and no link between
  components is lost.

``1 - (1 - 0.75**5)**40`` of the pairs at exactly 0.75 share a band (0.99998).

Defined cases: null, empty or blank texts have no set (``n_shingles`` 0) and link
with nothing; a null ``doc_id`` is compared only through its class, has a null
``component_id`` when no row of its class has an id, and is kept; rows that
repeat a ``doc_id`` count as one document; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, UPPER_TO_LOWER, components, cut, discard, mix, text_bytes, whole_groups, windows

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, K, BITS = 40, 5, 400, 1024
#: A pair stays a candidate when its sketches estimate at least this similarity;
#: five standard errors of the estimate below the threshold.
LEAST_ESTIMATE = 0.60
BLOCK = 2048
SHINGLES_A_ROW = 250

_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 2**31, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, K, dtype=np.uint64).astype(np.uint32)
_SPACE = np.empty((256, K), np.uint32)
_SALT = mix(_rng.integers(0, 2**63, K, dtype=np.uint64))


def most_bits(least: float) -> int:
    """XOR population count that the sketches of two sets with similarity ``least`` are expected to have."""
    return int(np.ceil(BITS * (1 - np.exp(-4 * K * (1 - least) / BITS)) / 2))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text_bytes(text).translate(UPPER_TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(HASHES.of(words), min(SHINGLE, len(words)), 0 if len(words) >= SHINGLE else 8 * len(words)))


def samples(values: np.ndarray) -> np.ndarray:
    """``K`` MinHash samples (uint32) of a set of shingle hashes."""
    low = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    best = None
    for i in range(0, len(low), len(_SPACE)):
        part = low[i:i + len(_SPACE)]
        space = _SPACE[:len(part)]
        np.multiply(part, _A, out=space)
        np.add(space, _B, out=space)
        best = space.min(0) if best is None else np.minimum(best, space.min(0))
    return best


def sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as ``BITS / 64`` signed words."""
    at = (mix(sample.astype(np.uint64) ^ _SALT) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def band_keys(sample: np.ndarray) -> np.ndarray:
    return windows_of_rows(sample[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64))


def windows_of_rows(rows: np.ndarray) -> np.ndarray:
    total = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows.shape[1]):
        total = mix(total ^ rows[:, j])
    return total.view(np.int64)


def _features(batches):
    for batch in batches:
        ids, count, sig, keys, odd = batch.column("doc_id"), [], [], [], []
        for text in batch.column("text").to_pylist():
            values = shingles(text)
            count.append(len(values))
            if len(values):
                sample = samples(values)
                sig.append(xxhash.xxh3_128_digest(values.tobytes()))
                keys.append(band_keys(sample))
                odd.append(sketch(sample))
            else:
                sig.append(None), keys.append(None), odd.append(None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(count, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
             pa.array(odd, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "sig", "keys", "odd"])


def _sets(batches):
    for batch in batches:
        found = [shingles(x).view(np.int64) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "values"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(percent: int, limit: int):
    """Pairs of components (``own``) that a link joins, over rows sorted by ``key, bm,
    bo``: the rows of a block of the band's main component (``side`` 0) against those
    of a block outside it (1); where ``bm`` is negative, outside blocks among themselves.
    A pair is compared in the first band that both share, closest sketches first, and
    no more once its components are joined, so no pair becomes a row."""
    def run(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for table in whole_groups(batches, ["key", "bm", "bo"]):
            key, bm, bo, side, ids, own = (table.column(c).to_numpy() for c in ("key", "bm", "bo", "side", "doc_id", "own"))
            odd, keys, values = (table.column(c).combine_chunks() for c in ("odd", "keys", "values"))
            odd = odd.flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
            keys = keys.flatten().to_numpy().reshape(len(ids), -1)
            ends, flat = values.offsets.to_numpy() - values.offsets[0].as_py(), values.flatten().to_numpy().view(np.uint64)
            band = (keys == key[:, None]).argmax(1)
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bm[1:] != bm[:-1]) | (bo[1:] != bo[:-1])])
            a, b = [], []
            for first, end in zip(new, np.r_[new[1:], len(ids)]):
                group = np.arange(first, end)
                among = bm[first] < 0
                for x in (group if among else group[side[group] == 1]).tolist():
                    other = np.arange(x + 1, end) if among else group[side[group] == 0]
                    other = other[own[other] != own[x]]
                    far = np.bitwise_count(odd[other] ^ odd[x]).sum(1)
                    other, far = other[far <= limit], far[far <= limit]
                    near = (keys[other] == keys[x]).argmax(1) == band[x]
                    for y in other[near][np.argsort(far[near], kind="stable")].tolist():
                        u, v = find(int(own[x])), find(int(own[y]))
                        if u != v and similar(flat[ends[x]:ends[x + 1]], flat[ends[y]:ends[y + 1]], percent):
                            parent[max(u, v)] = min(u, v)
                            a.append(u), b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _dealt(left: DataFrame, size: int) -> DataFrame:
    """Rows ``key, doc_id, own`` of bands that hold several components, dealt to
    groups.  A band's main component is its largest; rows of one component need not
    meet, so its rows are repeated only for the blocks outside it, of which there is
    nearly always one, and the rows outside for its blocks and for each other."""
    parts = left.groupBy("key", "own").agg(F.count(F.lit(1)).alias("_n"))
    main = parts.groupBy("key").agg(F.max(F.struct("_n", "own")).alias("_m"), F.sum("_n").alias("_all"))
    main = main.select("key", F.col("_m.own").alias("_main"), F.ceil(F.col("_m._n") / F.lit(size)).cast("int").alias("_km"),
                       F.ceil((F.col("_all") - F.col("_m._n")) / F.lit(size)).cast("int").alias("_ko"))
    d = left.join(main, "key").withColumn("side", (F.col("own") != F.col("_main")).cast("int"))
    block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("side") == 0, F.col("_km")).otherwise(F.col("_ko"))).cast("int")
    columns = ["key", "bm", "bo", "side", "doc_id", "own"]
    d = d.withColumn("_b", block)
    mine = d.where("side = 0").withColumn("bm", F.col("_b")).withColumn("bo", F.explode(F.sequence(F.lit(0), F.col("_ko") - 1)))
    theirs = d.where("side = 1").withColumn("bo", F.col("_b")).withColumn("bm", F.explode(F.sequence(F.lit(0), F.col("_km") - 1)))
    # two outside blocks meet in one group, which names both
    pair = F.explode(F.sequence(F.lit(0), F.col("_ko") - 1))
    among = (d.where("side = 1").withColumn("_o", pair).withColumn("bm", -1 - F.least("_b", "_o"))
             .withColumn("bo", F.greatest("_b", "_o")))
    return mine.select(columns).unionByName(theirs.select(columns)).unionByName(among.select(columns))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("b"), F.col("values").alias("_vb"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("values").alias("_va"))
    joined = pairs.join(one, "b").join(two, "a").withColumn("_i", F.size(F.array_intersect("_va", "_vb")))
    return joined.where(F.lit(100) * F.col("_i") >= F.lit(percent) * (F.size("_va") + F.size("_vb") - F.col("_i"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = cut(docs.mapInArrow(_features, "doc_id long, n_shingles long, sig binary, keys array<long>, odd array<long>"), "features")
    # rows of the steps below; a document counts more the longer it is
    n = features.agg(F.count(F.lit(1)) + F.floor(F.coalesce(F.sum("n_shingles"), F.lit(0)) / SHINGLES_A_ROW)).first()[0]
    narrow = features.select("doc_id", "n_shingles", "sig")
    classes = narrow.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    reps = cut(features.join(classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "sig"), ["doc_id", "sig"], "left_semi")
               .dropDuplicates(["doc_id", "sig"]).select("doc_id", "keys", "odd"), "representatives", n)

    banded = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("_x")).where("_x > pivot").drop("_x")
    members = cut(banded.join(shared, "key"), "members", n)

    limit = most_bits(LEAST_ESTIMATE)
    odd = reps.select("doc_id", "odd")
    star = members.where("doc_id > pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = (star.join(odd.select(F.col("doc_id").alias("b"), F.col("odd").alias("_ob")), "b")
            .join(odd.select(F.col("doc_id").alias("a"), F.col("odd").alias("_oa")), "a")
            .where(F.aggregate(F.zip_with("_oa", "_ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) <= limit)
            .select("a", "b"))
    wanted = members.select("doc_id").distinct()
    sets = cut(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_sets, "doc_id long, values array<long>"), "sets", n)
    links = cut(confirmed(star, sets, percent), "links", n)
    known = components(links)

    # bands that hold several components: rows outside the main one are compared with it
    # and with each other
    placed = members.select("key", "doc_id").join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = cut(placed.select("key", "doc_id", F.coalesce("component", "doc_id").alias("own")), "placed", n)
    split = placed.groupBy("key").agg(F.min("own").alias("_lo"), F.max("own").alias("_hi")).where("_lo < _hi").select("key")
    left = cut(placed.join(split, "key"), "left", n)
    dealt = _dealt(left, BLOCK).join(reps, "doc_id").join(sets, "doc_id")
    more = cut(dealt.repartition("key", "bm", "bo").sortWithinPartitions("key", "bm", "bo")
               .mapInArrow(_block_links(percent, limit), "a long, b long"), "more", n)
    merged = components(more)
    discard(members, sets, placed, left)

    first = known.withColumnRenamed("id", "rep").withColumnRenamed("component", "_first")
    second = merged.select(F.col("id").alias("_c1"), F.col("component").alias("_second"))
    named = (classes.join(first, "rep", "left").withColumn("_c1", F.coalesce("_first", "rep")).join(second, "_c1", "left")
             .select("sig", F.coalesce("_second", "_c1").alias("_c")))
    with_set = narrow.where("sig is not null").join(named, "sig").select("doc_id", "n_shingles", F.col("_c").alias("component_id"))
    without = narrow.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
