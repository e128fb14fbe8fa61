"""Operator 11 against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from corpus import DOCS, documents, lower_ascii
from trajframe.llm import lexical_search as lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(lower_ascii(text or ""))


def plain(rows, items, k):
    docs = [(d, Counter(words(t))) for d, t in rows]
    n_docs = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in docs:
            if not c:
                continue
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed=4, n=300):
    r = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(common) if r.random() < 0.7 else f"Rare{r.randrange(300)}" for _ in range(r.choice([3, 10, 40, 200])))
        rows.append((i * 7 % (2 * n + 1), rows[r.randrange(len(rows))][1] if i % 6 == 5 else text))
    rows += [(5000, None), (5001, ""), (5002, "!?-"), (5003, "É été É c1"), (5004, "c1_c2-C3.c4" + " c5" * 50_000), (5005, rows[3][1]), (5005, rows[3][1]), (None, rows[3][1])]
    items = [(i, " ".join(r.choice(common) if r.random() < 0.6 else f"rare{r.randrange(300)}" for _ in range(r.randrange(1, 30)))) for i in range(25)]
    items += [(100, None), (101, "  "), (102, "unseen"), (103, "É c1"), (3, "more rare5"), (None, "c7 c8"), (104, rows[3][1])]
    return rows, items


@pytest.mark.parametrize("shard, leaf, together, terms, stretch", [(16_384, 32, 256, 1 << 20, 1 << 22), (37, 1, 2, 40, 50), (64, 4, 8, 100, 1 << 22)])
def test_best_documents_of_every_item(spark, monkeypatch, shard, leaf, together, terms, stretch):
    rows, items = corpus()
    # the kernel runs in this process too, so that its settings can be varied
    for name, value in {"SHARD": shard, "LEAF": leaf, "TOGETHER": together, "TERMS": terms, "STRETCH": stretch}.items():
        monkeypatch.setattr(lexical, name, value)
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    for k in (50, 5):
        got = lexical.lexical_search(documents(spark, rows).repartition(3), bench, k)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, items, k)


@pytest.mark.parametrize("leaf, together", [(1, 1), (1, 3), (5, 2), (64, 256)])
def test_intervals_lose_no_document(monkeypatch, leaf, together):
    import numpy as np
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "TOGETHER", together)
    r = np.random.default_rng(leaf)
    for _ in range(30):
        n, v = int(r.integers(1, 60)), 12
        held = [np.sort(r.choice(v, int(r.integers(1, 9)), replace=False)) for _ in range(n)]
        sizes = np.array([len(h) for h in held])
        terms, counts = np.concatenate(held).astype(np.int32), r.integers(1, 9, sizes.sum())
        weights = r.integers(0, 50, v)
        ids, lengths = r.permutation(n), r.integers(10, 500, n)
        shard = lexical.Shard(ids, np.zeros(n, np.int64), lengths, sizes, terms, counts, weights, n, int(lengths.sum()))
        asked = r.choice(v, 5, replace=False)
        best = lexical.Best(7)
        looked = shard.search(asked, best)
        at = np.repeat(np.arange(n), sizes)
        m = 50 + 50 * lengths * n // lengths.sum()
        impact = weights[terms] * (10**9 * counts // (1000 * counts + 20 * m[at]))
        score = np.bincount(at[np.isin(terms, asked)], impact[np.isin(terms, asked)], n).astype(np.int64)
        want = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if s > 0)[:7]
        assert list(zip((-best.score).tolist(), best.row[:, 1].tolist())) == want and looked <= 2 * n + 1


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), documents(spark, [(1, "c1 c2")])
    items = spark.createDataFrame([(1, "c1")], "item_id long, text string")
    assert lexical.lexical_search(none, items).collect() == []
    assert lexical.lexical_search(some, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in lexical.lexical_search(some, items).collect()] == [(1, 1, 1)]
