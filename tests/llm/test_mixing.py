import pytest
from corpus import documents, split

from trajframe.llm import mixing as mx


def shares(sizes: dict):
    """Targets by refilling until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        full |= over


def test_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (i % 37)) + ("\n" if i % 2 else ""), [None, "b", "a", "é", "Z", "z"][0 if i < 200 else i % 6]) for i in range(600)]
    rows += [(900, None, "a"), (901, "", "only empty"), (None, "x y", "b"), (950, "x y", "b"), (950, "x y", "b")]
    frame = documents(spark, rows)
    got = mx.mix(frame).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    of = {}
    for d, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(split(text))
        of.setdefault(d, s)
    want = shares(sizes)
    for r in got:
        s = of[r.doc_id]
        assert r.taken <= 2 * r.size and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] = taken.get(s, 0) + r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 4, s            # blocks are one word here
    assert sorted(map(tuple, mx.mix(frame.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_schedule_is_even(spark):
    sized = spark.createDataFrame([("a", 3000), ("b", 1000), ("c", 2000)], "source string, size long")
    slots = [r.rank for r in mx.schedule(mx.targets(sized), 9000).orderBy("slot").collect()]
    assert len(slots) == 9000
    for n in (90, 900, 9000):
        for rank, share in ((1, .5), (2, 1 / 6), (3, 1 / 3)):
            assert abs(slots[:n].count(rank) - n * share) <= 4


def test_empty(spark):
    assert mx.mix(documents(spark, [(1, "a")]).where("doc_id < 0")).collect() == []
    assert [r.taken for r in mx.mix(documents(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_small_sources_beside_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(mx, "SLOTS", 64)                  # blocks of hundreds of words
    rows = [(i, " ".join(["w"] * 97), "big") for i in range(300)] + [(1000 + i, "a b c d e", f"tiny{i % 7}") for i in range(70)]
    rows += [(2000 + i, " ".join(["v"] * 60), None) for i in range(12)]
    of, want, taken = {d: s for d, _, s in rows}, {}, {}
    for r in mx.mix(documents(spark, rows)).collect():
        assert 0 <= r.taken <= 2 * r.size
        want[of[r.doc_id]] = r.target
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert len(want) == 9 and all(abs(taken[s] - want[s]) <= 1 for s in want), (want, taken)


@pytest.mark.parametrize("slots", [64, 131072])
def test_places_in_the_mix_follow_the_schedule(spark, monkeypatch, slots):
    monkeypatch.setattr(mx, "SLOTS", slots)
    rows = [(i, " ".join(["w"] * (5 + i % 40)), "abc"[i % 3]) for i in range(300)] + [(900, " ", "a"), (None, None, "b")]
    source = {d: s for d, _, s in rows}
    first = mx.mix(documents(spark, rows)).collect()
    assert all((r.first_slot is None) == (r.taken == 0) for r in first)
    # every source comes early, and what is taken once only is spread over the whole mix
    of, last = {}, max(r.first_slot for r in first if r.taken)
    for r in first:
        if r.taken:
            of.setdefault(source[r.doc_id], []).append((r.first_slot, r.target / r.source_size))
    assert set(of) == set("abc") and all(min(v)[0] <= 8 for v in of.values())
    assert all(max(v)[0] > 0.8 * last for v in of.values() if v[0][1] <= 1)
    monkeypatch.setattr(mx, "PHI", 0.25)
    other = {r.doc_id: r.first_slot for r in mx.mix(documents(spark, rows)).collect()}
    assert any(other[r.doc_id] != r.first_slot for r in first)
