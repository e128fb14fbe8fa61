import random

import numpy as np
import pytest
from corpus import documents, mixed_corpus, near_components, prose

from trajframe.llm import near_minhash as nm


def check(spark, rows):
    got = nm.near_duplicates(documents(spark, rows)).collect()
    sets, component = near_components([r for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id), r


def test_equals_brute_force(spark):
    check(spark, mixed_corpus())


def test_chain_and_hot_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(nm, "BLOCK", 4)
    base = prose(5, 80)
    r = random.Random(3)
    rows = []
    for i in range(40):                     # a large group of near copies, some of them just below the threshold
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    chain = prose(6, 100)
    for i in range(6):                      # each like the one before, the ends unlike each other
        rows.append((100 - i, " ".join(chain[i * 8:] + [f"c{j}" for j in range(i * 8)])))
    check(spark, rows)


def test_null_ids_and_empty_table(spark):
    got = nm.near_duplicates(documents(spark, [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (None, "x y")])).collect()
    seen = sorted(((r.doc_id is None, r.n_shingles, r.component_id, r.kept) for r in got), key=repr)
    assert seen == sorted([(False, 2, 4, True), (True, 2, 4, True), (True, 0, None, True), (True, 1, None, True)], key=repr)
    assert nm.near_duplicates(documents(spark, [(1, None)]).where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("share", [0.6, 0.75, 0.9])
def test_sketch_estimates_similarity(share):
    rng = np.random.default_rng(1)
    n = 2000
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    same = int(round(2 * n * share / (1 + share)))
    b = np.r_[a[:same], rng.integers(0, 2**63, n - same, dtype=np.uint64)]
    x = nm.sketch(nm.samples(a)) ^ nm.sketch(nm.samples(b))
    differ = int(np.bitwise_count(x.view(np.uint64)).sum())
    estimate = 1 + nm.BITS / (4 * nm.K) * np.log(1 - 2 * differ / nm.BITS)
    assert abs(estimate - share) < 0.1
