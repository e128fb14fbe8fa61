"""Operator 11, ranked lexical search over range-maximum sparse tables.

Each task indexes the documents it reads in shards of up to ``SHARD`` documents.  A
shard holds, for every term of the items, the posting list of its documents with
their impacts (a document's share of the score), and over the lists a sparse table
of the position of the greatest impact in every run of ``2**j`` postings.  An
interval of documents is bounded by the sum, over an item's terms, of the greatest
impact each list has there, two lookups a term.  Intervals wait in order of their
bounds; the best ones, ``TOGETHER`` at a time, are split at the document of their
greatest impact, which is scored, and both remaining intervals are bounded anew;
intervals of up to ``LEAF`` documents are scored whole.  It ends when no bound
reaches the item's k-th best score, which is carried from shard to shard.
A shard lists its documents by their most frequent term and by length, so that
those which share terms lie together.

* One pass counts every document's terms and keeps those that items hold; document
  frequencies are summed in the tasks.  Postings are never shuffled: what leaves a
  task is k documents an item, merged in two steps.
* Items are the stated query set: they go to the tasks in blocks of about ``TERMS``
  distinct terms, one pass a block, whatever their number.

Defined cases: null or empty texts have no terms and are in no result; repeated
documents keep a row each, equal scores go by ``doc_id``, null ids last; rows that
repeat an ``item_id`` are one item of all their terms, a null id is an item too;
items without terms have no rows; very long texts are split into words stretch by
stretch; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, text_bytes

K = 50
SHARD, POSTINGS, LEAF, TOGETHER = 16_384, 2_000_000, 32, 256
TERMS, STRETCH, SALTS = 1 << 20, 1 << 22, 64

#: ASCII letters in lower case, digits and all bytes outside ASCII stay; the rest separates.
WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
FEATURES = "doc_id long, n long, terms array<int>, counts array<long>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(text: str | None):
    """Lists of a text's terms, one for each stretch of it."""
    data = text_bytes(text).translate(WORD_BYTES)
    start = 0
    while len(data) - start > STRETCH:
        end = data.find(b" ", start + STRETCH)
        if end < 0:
            break
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def _item_terms(batches):
    for batch in batches:
        found = [sorted({t for part in terms_of(x) for t in part}) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _features(vocabulary):
    def run(batches):
        number = vocabulary.value
        for batch in batches:
            n, sizes, terms, counts = [], [0], [], []
            for text in batch.column("text").to_pylist():
                total, held = 0, Counter()
                for words in terms_of(text):
                    total += len(words)
                    held.update(filter(number.__contains__, words))
                n.append(total)
                terms += map(number.__getitem__, held)
                counts += held.values()
                sizes.append(len(terms))
            ends = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "counts"])
    return run


def _frequencies(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])
    return run


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.row = k, np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    @property
    def least(self) -> int:
        """A score that a document must reach; no document without a term counts."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score, ids, unnamed) -> None:
        may = score >= self.least
        if may.any():
            score = np.r_[self.score, score[may]]
            row = np.vstack([self.row, np.c_[unnamed[may], ids[may]]])
            order = np.lexsort((row[:, 1], row[:, 0], -score))[:self.k]
            self.score, self.row = score[order], row[order]


class Shard:
    """Posting lists of some documents, end to end, under one sparse table.  A run of
    the table that crosses the border of two lists is never asked for."""

    def __init__(self, ids, unnamed, lengths, sizes, terms, counts, weights, documents: int, tokens: int):
        n = self.n = len(ids)
        at = np.repeat(np.arange(n), sizes)
        m = 50 + (50 * lengths * documents) // tokens
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[at]))
        common = np.full(n, -1)
        rising = np.lexsort((terms, counts))
        common[at[rising]] = terms[rising]                      # a document's most frequent term
        order = np.lexsort((m, common))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.unnamed = ids[order], unnamed[order]
        key = terms.astype(np.int64) * n + place[at]
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[order]
        self.at = self.key % max(n, 1)
        longest = int(np.bincount(terms).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        self.log[1:] = np.floor(np.log2(np.arange(1, longest + 1)))
        self.table = np.zeros((int(self.log[-1]) + 1, len(key)), np.int32)
        self.table[0] = np.arange(len(key))
        for j in range(1, len(self.table)):
            half, now = 1 << (j - 1), self.table[j - 1]
            left, right = now[:-half], now[half:]
            self.table[j, :len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)

    def maxima(self, a, b):
        """Greatest impact in postings ``a`` to ``b`` of each term and interval: the
        intervals' bounds, and the documents of their greatest impact."""
        size = b - a
        held = size > 0
        level = self.log[size]
        left = self.table[level, np.where(held, a, 0)]
        right = self.table[level, np.where(held, b - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        value = np.where(held, self.impact[best], 0)
        column = np.arange(a.shape[1])
        return value.sum(0), self.at[best[value.argmax(0), column]]

    def search(self, terms, best: Best) -> int:
        """Adds to ``best`` this shard's documents for an item; intervals looked at."""
        base = terms.astype(np.int64) * self.n
        a, b = np.searchsorted(self.key, base), np.searchsorted(self.key, base + self.n)
        base, a, b = base[b > a], a[b > a][:, None], b[b > a][:, None]
        if not len(base):
            return 0
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        bound, split = self.maxima(a, b)
        seen = 1
        while True:
            may = np.flatnonzero(bound >= best.least)
            may = may[np.argsort(-bound[may], kind="stable")]
            if not len(may):
                return seen
            now, later = may[:TOGETHER], may[TOGETHER:]
            leaf = hi[now] - lo[now] <= LEAF
            self.score_whole(a[:, now[leaf]], b[:, now[leaf]], best)
            cut_ = now[~leaf]
            d = split[cut_]
            r = np.searchsorted(self.key, base[:, None] + d)
            there = np.minimum(r, len(self.key) - 1)
            holds = self.key[there] == base[:, None] + d
            best.add(np.where(holds, self.impact[there], 0).sum(0), self.ids[d], self.unnamed[d])
            new_lo, new_hi = np.r_[lo[cut_], d + 1], np.r_[d, hi[cut_]]
            new_a, new_b = np.hstack([a[:, cut_], r + holds]), np.hstack([r, b[:, cut_]])
            some = new_hi > new_lo
            new_lo, new_hi, new_a, new_b = new_lo[some], new_hi[some], new_a[:, some], new_b[:, some]
            new_bound, new_split = self.maxima(new_a, new_b)
            seen += len(new_lo)
            lo, hi, bound, split = np.r_[lo[later], new_lo], np.r_[hi[later], new_hi], np.r_[bound[later], new_bound], np.r_[split[later], new_split]
            a, b = np.hstack([a[:, later], new_a]), np.hstack([b[:, later], new_b])

    def score_whole(self, a, b, best: Best) -> None:
        """Scores every document that holds a posting of the given ranges."""
        a, size = a.ravel(), (b - a).ravel()
        if not size.sum():
            return
        posting = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        d, which = np.unique(self.at[posting], return_inverse=True)
        score = np.zeros(len(d), np.int64)
        np.add.at(score, which, self.impact[posting])
        best.add(score, self.ids[d], self.unnamed[d])


def shards(batches, weights, documents: int, tokens: int):
    """Shards of the documents that come, bounded in documents and postings."""
    held, n, size = [], 0, 0

    def build():
        table = pa.Table.from_batches(held).combine_chunks()
        ids, terms, counts = (table.column(c).combine_chunks() for c in ("doc_id", "terms", "counts"))
        return Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), table.column("n").to_numpy(),
                     np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), counts.flatten().to_numpy(), weights, documents, tokens)

    for batch in batches:
        for start in range(0, batch.num_rows, SHARD):
            part = batch.slice(start, SHARD)
            more = len(part.column("terms").flatten())
            if held and (n + part.num_rows > SHARD or size + more > POSTINGS):
                yield build()
                held, n, size = [], 0, 0
            held.append(part)
            n, size = n + part.num_rows, size + more
    if held:
        yield build()


def _search(asked, documents: int, tokens: int, k: int):
    def run(batches):
        items, weights = asked.value
        best = [Best(k) for _ in items]
        for shard in shards(batches, weights, documents, tokens):
            for (_, terms), b in zip(items, best):
                shard.search(terms, b)
        for (item, _), b in zip(items, best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(b.score), pa.int64()), pa.array(b.row[:, 1], mask=b.row[:, 0] == 1),
                                                  pa.array(b.score)], ["item_id", "doc_id", "score"])
    return run


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The best documents of one block of ``(item_id, terms)`` in every task's documents."""
    context = docs.sparkSession.sparkContext
    number = {t: i for i, t in enumerate(sorted({bytes(t) for _, terms in items for t in terms}))}
    features = cut(docs.mapInArrow(_features(context.broadcast(number)), FEATURES), "features")
    documents, tokens = features.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    df = np.zeros(len(number), np.int64)
    for term, held in features.select("terms").mapInArrow(_frequencies(len(number)), "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = held
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = context.broadcast(([(i, np.array([number[bytes(t)] for t in terms], np.int64)) for i, terms in items], weights))
    found = cut(features.where("size(terms) > 0").mapInArrow(_search(asked, documents, tokens or 1, k), FOUND), "found")
    discard(features)
    return found


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, terms array<binary>")
                .groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where("size(terms) > 0"), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    found = spark.createDataFrame([], FOUND)
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        found = found.unionByName(_block(docs, rows, k)) if rows else found
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.row_number().over(Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return (found.withColumn("_p", part).where(F.col("_p") <= k).drop("_p").withColumn("rank", rank).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


SQL = r"""
with words as (
  select doc_id, w.doc_row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select doc_id, text, row_number() over () as doc_row from documents) w),
tf as (select doc_row, any_value(doc_id) as doc_id, term, count(*)::bigint as tf from words group by doc_row, term),
lengths as (select doc_row, sum(tf)::bigint as n from tf group by doc_row),
totals as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from lengths),
asked as (select distinct item_id, term from (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)),
weights as (select term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, totals group by term),
scored as (
  select item_id, doc_row, any_value(tf.doc_id) as doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::bigint as score
  from asked join tf using (term) join weights using (term) join lengths using (doc_row), totals group by item_id, doc_row)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id nulls last) <= 50
"""
