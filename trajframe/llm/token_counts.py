"""Operator 13, token counts through a digest cache.

A text's key is the SHA-256 of its normalised content; a tokenizer's version is
the SHA-256 of its vocabulary file, its library and that library's version.  The
cache is a Parquet table ``tokenizer=<version>/`` of ``content, n_tokens``.  The
documents' keys (32 bytes each) are grouped and joined to the cache; of every key
that it lacks the text of one document, the one with the smallest id, is encoded,
and the counts are appended.  All documents then take their counts from the cache
by a join on the key, so a group of copies of any size costs one encoding.

Normalised content: null is the empty text; where the tokenizer declares a
normaliser, a text that holds none of its added tokens is normalised by it (its
count depends on that form alone), any other text stays as it is.

The library's own encoder counts the tokens.  A byte-level tokenizer without
normaliser starts a new piece wherever white space follows another character, so
its texts are cut there and the counts of short pieces are kept and looked up; texts
that hold white space outside ASCII are encoded whole.

An appended row is right by itself: a run that is stopped leaves a shorter cache,
two runs at once leave repeated rows, which the next reader groups.

Defined cases: null and empty texts have 0 bytes and, with these tokenizers, 0
tokens; repeated rows keep a row each; a null ``doc_id`` stays null; texts of any
length are encoded whole, in stretches of ``STRETCH`` bytes where that is exact; an
empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import cut

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
STRETCH = 1 << 22
CACHE = "content binary, n_tokens long"

#: White space of Unicode outside ASCII, and the separators 1C-1F, as UTF-8.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
PIECES = re.compile(rb"\s*\S+|\s+")
CUT = re.compile(rb"\S\s")
MARKS = b"!#$%&*,.?:;"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def version_of(path: str) -> str:
    """Digest of what decides a count: vocabulary, library, library version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


class Counter:
    """Token counts of texts by the library that the file belongs to."""

    KEPT, LONGEST = 1_000_000, 48

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_pieces, self.marks, self.known = False, [], {}
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor
            self.model = SentencePieceProcessor(model_file=path)
            self.normaliser = self.model.normalize
            self.sizes = lambda texts: list(map(len, self.model.encode(texts, num_threads=1)))
            return
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.sizes = lambda texts: [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.marks = [t["content"] for t in added]
        self.normaliser = self.model.normalizer.normalize_str if self.model.normalizer else None
        split = spec.get("pre_tokenizer") or {}
        self.by_pieces = (not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                          and not split.get("add_prefix_space")
                          and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added))

    def normalised(self, text: str | None) -> bytes:
        """What the key of a text is made of."""
        text = text or ""
        if self.normaliser is None or any(m in text for m in self.marks):
            return b"=" + text.encode("utf-8", "surrogatepass")
        return b"~" + self.normaliser(text).encode("utf-8", "surrogatepass")

    def learn(self, pieces) -> None:
        """Counts of pieces not seen yet.  Marks after an ASCII letter are a piece of
        their own, so a word is encoded once for all its marks."""
        known, parts = self.known, {}
        for p in pieces:
            stem = p.rstrip(MARKS)
            parts[p] = (stem, p[len(stem):]) if stem != p and stem[-1:].isalpha() else (p, b"")
        new = list({x for pair in parts.values() for x in pair if x not in known} - {b""})
        known.update(zip(new, self.sizes([x.decode() for x in new])))
        known.setdefault(b"", 0)
        known.update((p, known[a] + known[b]) for p, (a, b) in parts.items())

    def of_stretch(self, data: bytes) -> int:
        pieces = PIECES.findall(data)
        known = self.known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > self.KEPT:
            known.clear()
        long = [p for p in pieces if len(p) > self.LONGEST]
        short = [p for p in pieces if len(p) <= self.LONGEST] if long else pieces
        self.learn(set(short).difference(known))
        return sum(map(known.__getitem__, short)) + sum(self.sizes([p.decode() for p in long]))

    def of(self, text: str) -> int:
        """Tokens of a whole text."""
        data = text.encode()
        if not self.by_pieces or OTHER_SPACE.search(data):
            return self.sizes([text])[0]
        total = start = 0
        while len(data) - start > STRETCH:
            end = CUT.search(data, start + STRETCH)
            if end is None:
                break
            total += self.of_stretch(data[start:end.start() + 1])
            start = end.start() + 1
        return total + self.of_stretch(data[start:])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a worker process, with what it has seen."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _keys(path: str):
    def run(batches):
        of = counter(path).normalised
        for batch in batches:
            found = [hashlib.sha256(of(x)).digest() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, pa.binary())], ["doc_id", "text", "content"])
    return run


def _counts(path: str):
    def run(batches):
        of, seen = counter(path).of, set()
        for batch in batches:
            content = batch.column("content").to_pylist()
            new = [i for i, c in enumerate(content) if not (c in seen or seen.add(c))]
            if len(seen) > Counter.KEPT:
                seen.clear()
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([pa.array([content[i] for i in new], pa.binary()),
                                              pa.array([of(texts[i].as_py()) for i in new], pa.int64())], ["content", "n_tokens"])
    return run


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of one tokenizer version, each content once."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(folder).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, cache: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.  ``cache`` names a
    folder that all executors share and that later calls use again; without it the
    counts are kept for this call alone."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    kept = cache is not None
    cache = cache or f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/token-counts"
    folder = f"{cache}/tokenizer={version_of(path)}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if counter(path).normaliser is None:
        keyed = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    else:
        keyed = docs.mapInArrow(_keys(path), "doc_id long, text string, content binary")

    stored = cached(spark, folder)
    wanted = (keyed.groupBy("content").agg(F.min("doc_id").alias("_first"))
              .join(stored, "content", "left_anti").withColumnRenamed("content", "_content"))
    one = (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    missing = keyed.join(wanted.hint("shuffle_hash"), one, "left_semi").select("content", "text")
    missing.mapInArrow(_counts(path), CACHE).write.mode("append").parquet(folder)

    # a content that many documents share is a hot key: with a plain table on the
    # other side Spark splits its rows
    counts = cut(cached(spark, folder).join(keyed.select("content"), "content", "left_semi") if kept else cached(spark, folder), "counts")
    narrow = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return (narrow.join(counts, "content")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
