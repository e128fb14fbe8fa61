import hashlib

from corpus import by_id, cut_repeats, documents, mixed_corpus, prose

from trajframe.llm import substring as sub


def check(spark, rows):
    got = sub.substring_dedup(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = cut_repeats([r for r in rows if r[0] is not None])
    for r in got:
        n, removed, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest()), r
        if removed:
            assert r.kept_text == kept and sum(s.end - s.start for s in r.spans) >= removed


def test_equals_brute_force(spark):
    check(spark, mixed_corpus())


def test_branches_ties_and_overlaps(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    check(spark, [(1, " ".join(a + b)), (2, " ".join(a[:20] + c)), (3, " ".join(c[10:] + b[5:30] + a[3:18])),
                  (4, " ".join(a[:13])), (5, " ".join(a[:12])), (6, " ".join(["x"] * 40)), (7, " ".join(["x"] * 30)), (8, " ".join(b + b))])


def test_defined_cases(spark):
    text = " ".join(prose(4, 30))
    got = by_id(sub.substring_dedup(documents(spark, [(None, text), (5, text), (9, None), (7, text), (7, text), (7, "other text")])).collect())
    assert [r.n_removed for r in got[5]] == [0] and [r.n_removed for r in got[None]] == [0] and got[9][0].n_words == 0
    assert sorted(r.n_removed for r in got[7]) == [0, 30, 30]
    assert sub.substring_dedup(documents(spark, [(1, "a")]).where("doc_id < 0")).collect() == []
