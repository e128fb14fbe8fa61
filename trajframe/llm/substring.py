"""Operator 9, repeated spans by a compacted de Bruijn graph of words.

Edges of the graph are runs of ``WINDOW`` words (nodes: ``WINDOW - 1`` words).
Only edges that occur in two different texts matter, so

1. texts with equal word sequences are one class, of which one takes part: a
   copy with a larger id loses every word;
2. every edge is filed under its minimizer, the least hash of its runs of
   ``PART`` words; minimizers of a single text (most of them) go, found by a
   partial aggregate, and with them all edges that cannot repeat;
3. the edges left are counted by a 96-bit hash, with the smallest document they
   start in and whether the edges before and after are always the same;
4. joined back to their source coordinates ``(document, start)``, edges that
   follow each other without a branch compact into one path span, and what the
   spans of a document cover is checked and cut from its words.

Words are runs without ASCII white space, unchanged.  A window of words goes
when its word sequence also starts in a document with a smaller id; windows are
judged on the input.

Defined cases: a null text has no words; fewer than ``WINDOW`` words are never
cut; rows with a null ``doc_id`` keep everything and are no source; rows that
repeat a ``doc_id`` are one document (neither is smaller), of different texts under
one id the one with the least hash takes part and the others keep everything."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, cut, discard, text_bytes, windows

WINDOW, PART = 13, 4
EMPTY = hashlib.sha256(b"").hexdigest()


def minimizers(hashes: np.ndarray) -> np.ndarray:
    """Least hash of the runs of ``PART`` words in each window (one value a window)."""
    least = windows(hashes, PART, 40)
    width, have = WINDOW - PART + 1, 1
    while have < width:                       # double the reach of the running minimum
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        have += step
    return least


def _features(batches):
    for batch in batches:
        size, sig, sha, least = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = text_bytes(text).split()
            joined = b" ".join(words)
            size.append(len(words)), sha.append(hashlib.sha256(joined).hexdigest())
            if len(words) >= WINDOW:
                sig.append(xxhash.xxh3_128_digest(joined))
                least.append(np.unique(minimizers(HASHES.of(words))).view(np.int64))
            else:
                sig.append(None), least.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(sha), pa.array(least, pa.list_(pa.int64()))],
            ["doc_id", "n_words", "sig", "sha", "least"])


def _of_class(batches):
    """Rows whose text is of the class that takes part under their id."""
    for batch in batches:
        same = [xxhash.xxh3_128_digest(b" ".join(text_bytes(t).split())) == s for t, s in zip(batch.column("text").to_pylist(), batch.column("sig").to_pylist())]
        yield batch.filter(pa.array(same, pa.bool_())).select(["doc_id", "text", "sig", "wanted"])


def _edges(batches):
    low = lambda x, bits: (x & np.uint64((1 << bits) - 1))
    for batch in batches:
        out = [[] for _ in range(5)]
        wanted_of = batch.column("wanted").to_numpy(zero_copy_only=False)
        for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), wanted_of):
            hashes = HASHES.of(text_bytes(text).split())
            at = np.flatnonzero(np.isin(minimizers(hashes).view(np.int64), wanted))
            one, two = windows(hashes, WINDOW), windows(hashes, WINDOW, 20)
            around = np.r_[np.uint64(0), low(one, 16), np.uint64(0)]
            for column, values in zip(out, (one[at].view(np.int64), low(two[at], 32).astype(np.uint32).view(np.int32), np.full(len(at), doc),
                                            at, (around[at] << np.uint64(16) | around[at + 2]).astype(np.uint32).view(np.int32))):
                column.append(values)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(out, kinds)], ["one", "two", "doc_id", "start", "around"])


def path_spans(start: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Word spans ``(start, end)`` of nonbranching paths: consecutive edges join
    unless the one ends (``last``) or the next begins (``first``) a path."""
    if not len(start):
        return []
    new = np.r_[True, (start[1:] != start[:-1] + 1) | first[1:] | last[:-1]]
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), (start[np.r_[at[1:], len(start)] - 1] + WINDOW).tolist()))


def _cuts(batches):
    for batch in batches:
        removed, sha, rest, spans = [], [], [], []
        for text, edges in zip(batch.column("text").to_pylist(), batch.column("edges").to_numpy(zero_copy_only=False)):
            words = text_bytes(text).split()
            edges = np.unique(edges)
            found = path_spans(edges >> 2, (edges & 2) > 0, (edges & 1) > 0)
            keep = np.ones(len(words), bool)
            for a, b in found:
                keep[a:b] = False
            kept = b" ".join(w for w, k in zip(words, keep) if k)
            removed.append(int(len(words) - keep.sum())), sha.append(hashlib.sha256(kept).hexdigest())
            rest.append(kept.decode("utf-8", "surrogatepass")), spans.append([{"start": a, "end": b} for a, b in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sig"), pa.array(removed, pa.int64()), pa.array(sha), pa.array(rest, pa.string()), pa.array(spans, kind)],
            ["doc_id", "sig", "n_removed", "kept_sha", "kept_text", "spans"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_removed, kept_sha256, kept_text,
    spans``; ``kept_text`` is null where nothing is removed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, sig binary, sha string, least array<long>"
    features = cut(docs.mapInArrow(_features, schema), "features")
    n = features.count()
    base = cut(features.select("doc_id", "n_words", "sig", "sha"), "base", n)

    class_of = F.xxhash64("sig")
    classes = base.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    chosen = classes.where("rep is not null").groupBy(F.col("rep").alias("doc_id")).agg(F.min("sig").alias("sig")).withColumn("c", class_of)
    least = features.where("doc_id is not null and sig is not null").select(class_of.alias("c"), F.explode("least").alias("h"))
    repeated = least.groupBy("h").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a < _b").select("h")
    wanted = cut(least.join(repeated, "h").groupBy("c").agg(F.collect_set("h").alias("wanted")).join(chosen, "c").select("sig", "doc_id", "wanted"), "wanted", n)
    discard(features)
    texts = cut(docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"])
                .mapInArrow(_of_class, "doc_id long, text string, sig binary, wanted array<long>"), "texts", n)
    discard(wanted)

    edges = cut(texts.mapInArrow(_edges, "one long, two int, doc_id long, start int, around int"), "edges", n)
    counted = cut(edges.groupBy("one", "two").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("_hi"), F.bit_and("around").alias("_and"), F.bit_or("around").alias("_or"))
                  .where("lo < _hi").select("one", "two", "lo", F.col("_and").bitwiseXOR(F.col("_or")).alias("differ")), "counted", n)
    # start, and whether a path begins or ends there, as one number
    flag = lambda c, value: F.when(c, value).otherwise(0)
    edge = F.col("start").cast("long") * 4 + flag(F.shiftrightunsigned("differ", 16) != 0, 2) + flag(F.col("differ").bitwiseAND(65535) != 0, 1)
    spans = cut(edges.join(counted, ["one", "two"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_list(edge).alias("edges")), "spans", n)
    discard(edges, counted)
    kind = "doc_id long, sig binary, n_removed long, kept_sha string, kept_text string, spans array<struct<start:int,end:int>>"
    cuts = cut(texts.join(spans, "doc_id").mapInArrow(_cuts, kind), "cuts", n).dropDuplicates(["doc_id", "sig"])
    discard(texts, spans)

    rows = base.join(classes, "sig", "left").join(cuts, ["doc_id", "sig"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))
    return rows.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.col("spans")).alias("spans"))


SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, p, sha256(array_to_string(w[p:p + 12], ' ')) as h
        from d, unnest(case when len(w) >= 13 then range(1, len(w) - 11) else [] end) t(p)),
first as (select h, min(doc_id) as lo from win group by h),
gone as (select doc_id, list(p order by p) as ps from win join first using (h) where doc_id > lo group by doc_id),
hit as (select distinct doc_id, q from gone, unnest(ps) a(p), unnest(range(p, p + 13)) b(q)),
cutoff as (select doc_id, list(q) as qs from hit group by doc_id),
kept as (select d.doc_id, len(w) as n, coalesce(len(qs), 0) as r,
                case when qs is null then w else list_filter(list_transform(w, lambda x, i: case when list_contains(qs, i) then null else x end), lambda x: x is not null) end as k
         from d left join cutoff using (doc_id))
select doc_id, n::bigint as n_words, r::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
