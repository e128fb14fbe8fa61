"""Helpers shared by the corpus operators: written cuts in the shared folder,
word hashing, connected components and bounded blocks of hot groups."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Java regex of the white space that separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"

#: Edges of a graph that one task handles in a round.
EDGES = 500_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Documents (or what stands for one) that a task of a written step handles at least.
LEAST_ROWS = 2_000


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back:
    lineage ends there, so a lost executor costs only the tasks it ran.  The
    shuffle files of the write are released when it is done.  With the number of
    ``rows`` that the step is about, a small step writes a few files instead of one
    for every partition."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // LEAST_ROWS + 1)
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*cuts: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in cuts:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


class WordHashes(dict):
    """64-bit hashes of words, kept for the frequent ones; emptied when large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = WordHashes()

_rng = np.random.default_rng(20240229)
#: Odd multipliers, one per position of a word in a window.
PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word (uint64, wraps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, k: int, shift: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` words; empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * PLACE[shift]
    for j in range(1, k):
        total += hashes[j:n + j] * PLACE[shift + j]
    return mix(total)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; a null text has none."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(id, component)`` with the
    smallest id of each component, for every id that has an edge.

    Alternating large-star and small-star rounds.  A star's centre is found by a
    partial aggregate and joined back, so a centre with a third of all edges is
    a skewed join side that Spark splits; every round is cut to the shared
    folder in a file for every ``EDGES`` edges; the driver sees two numbers a round."""
    def oriented(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def stars(pairs):
        # every (u, v) attaches v to the smallest of u and its neighbours in ``pairs``
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(oriented(edges), "edges")
    seen = mark(now)
    files = seen[0] // EDGES + 1
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = oriented(large)
        small = stars(large)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = cut(oriented(small).coalesce(files), "edges")
        found = mark(after)
        discard(now)
        now = after
        if found == seen:
            break
        seen = found
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def blocks(rows: DataFrame, key: str, id_col: str, size: int) -> DataFrame:
    """Deal the rows of every ``key`` to blocks of about ``size`` rows and
    repeat each row for every pair of blocks it belongs to, as columns ``bi <=
    bj`` and ``side`` (0: the row lies in ``bi``, 1: only in ``bj``).  A group
    of ``key, bi, bj`` then holds at most two blocks, whatever the key's size,
    and every two rows of a key meet in exactly one group."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    dealt = (rows.join(sizes, key)
             .withColumn("_k", F.ceil(F.col("_n") / F.lit(size)).cast("int"))
             .withColumn("_b", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col("_k")).cast("int")))
    return (dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
            .withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
            .withColumn("side", (F.col("_b") != F.col("bi")).cast("int"))
            .drop("_n", "_k", "_b", "_o"))


def whole_groups(batches, keys: list[str]):
    """From Arrow batches sorted by ``keys``: tables that hold whole groups only.
    What is carried over is the last, unfinished group."""
    import pyarrow as pa
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        n = table.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            same &= values == values[-1]
        first = n - int(same[::-1].argmin()) if not same.all() else 0
        if first:
            yield table.slice(0, first)
        rest = table.slice(first)
    if rest is not None and rest.num_rows:
        yield rest


def pairs_in_groups(starts: np.ndarray):
    """For rows sorted into groups (``starts[i]``: the row opens a group): yields
    ``(i, j)`` index arrays that together hold every two rows of a group."""
    n = len(starts)
    group = np.cumsum(starts)
    last = np.r_[np.flatnonzero(starts)[1:], n][group - 1] - 1        # last row of each row's group
    i = np.flatnonzero(last > np.arange(n))
    step = 1
    while len(i):
        yield i, i + step
        step += 1
        i = i[i + step <= last[i]]


def vectors_of(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column as doubles, short rows filled with zeros, and which rows
    hold a vector without null or non-finite components."""
    out, good = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for r, v in enumerate(column.to_pylist()):
        if v is not None and None not in v:
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all():
                out[r, :len(x)], good[r] = x, True
    return out, good
