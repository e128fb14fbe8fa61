import random
import zlib

import numpy as np
from corpus import documents, prose

from trajframe.llm import toxicity as tx

BAD = ["idiot", "moronic", "scum"]


def labelled(n=400, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, r.randrange(5, 300), 800)
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s!", "ic,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame([(i, 0, y, "x") for i, y in labels], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    rows += [(5000, None), (5001, ""), (None, "idiot scum"), (5002, "w1 " * 20000 + "idiot scum moronic " * 4)]
    got = tx.toxicity(documents(spark, rows), labels_of(spark, labels + [(None, 1), (5000, None), (3, 0)])).collect()
    assert len(got) == len(rows)
    y = dict(labels)
    held = [r for r in got if r.doc_id in y and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5000].score == by[5001].score < 0.5 and by[5000].passages == []
    assert by[5002].predicted == 1 and any(p.start >= 20000 - 1 for p in by[5002].passages)
    assert not by[None].held_out


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = labelled(120)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted(map(tuple, tx.toxicity(documents(spark, rows), labels_of(spark, x)).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = labels_of(spark, [(1, 1)]).where("doc_id < 0")
    assert [r.score for r in tx.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert tx.toxicity(docs.where("doc_id < 0"), labels_of(spark, [(1, 1)])).collect() == []


def slow_segments(x):
    """The best segment, then those left and right of it, again and again."""
    best = max(((sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    s, _, a, b = best
    return slow_segments(x[:a]) + [(a, b, s)] + [(b + i, b + j, v) for i, j, v in slow_segments(x[b:])]


def test_segments_equal_repeated_search():
    r = random.Random(1)
    for _ in range(200):
        x = [r.choice([-3, -1, 1, 2, 4]) * 1.0 + r.random() / 1000 for _ in range(r.randrange(0, 14))]
        found, slow = tx.segments(np.array(x)), slow_segments(x)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in slow]
        assert np.allclose([s for *_, s in found], [s for *_, s in slow])


def test_bounded_sample_keeps_the_class_ratio(spark, monkeypatch):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1200):                                 # one in ten is toxic, and clean texts hold bad words now and then
        words, toxic = prose(i, 60, 300), int(i % 10 == 0)
        for _ in range(r.randrange(1, 5) if toxic else r.randrange(0, 2) * r.randrange(0, 3)):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, known = documents(spark, rows), labels_of(spark, labels)
    whole = tx.fit(docs, known)
    monkeypatch.setattr(tx, "SAMPLE", 200)                # cuts the clean class only
    part = tx.fit(docs, known)
    assert abs(part["share"] - whole["share"]) < 0.01
    mean = [np.mean([x.score for x in tx.toxicity(docs, known).select("score").collect()])]
    monkeypatch.undo()
    mean.append(np.mean([x.score for x in tx.toxicity(docs, known).select("score").collect()]))
    print(mean, part["share"], whole["share"])
    assert abs(mean[0] - mean[1]) < 0.02 and abs(mean[1] - 0.1) < 0.02
