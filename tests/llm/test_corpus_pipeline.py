"""The pipeline, stage by stage, against plain versions of each stage on what the
stage before kept."""

import tempfile
from collections import Counter

import numpy as np
import pytest
from corpus import cut_repeats, mixed_corpus, near_components, prose

import corpus_pipeline as cp
from trajframe.llm import mixing, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _score string, sig string"


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    rows = mixed_corpus()
    bad = [(3000 + i, " ".join(prose(i, 40)[:20] + ["idiot", "scum"] * 3 + prose(i, 40)[20:])) for i in range(40)]
    rows = rows + bad + [(None, "no id at all here"), (None, None)]
    full = [(d, t, "en", None if k % 11 == 0 else f"s{k % 4}", len(t or ""), "x", "y") for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(d, 0, int(d >= 3000)) for d, _ in rows if d is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder):
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(cp.STAGES)
    assert [k for k, _ in cp.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "packing"]
    clean = cp.cut(stages["toxicity"](spark, docs, folder), "t")
    assert clean.columns == cp.COLUMNS
    kept, given = plain(clean), plain(docs)
    assert sum(d is not None and d >= 3000 for d, _ in kept) <= 4
    assert Counter(kept) & Counter(x for x in given if x[0] is None or x[0] < 3000) == Counter(x for x in given if x[0] is None or x[0] < 3000)

    unique = cp.cut(stages["near_duplicates"](spark, clean, folder), "t")
    _, component = near_components([x for x in kept if x[0] is not None])
    texts = dict(kept)
    assert sorted(d for d, _ in plain(unique) if d is not None) == sorted(d for d in component if component[d] == d)
    assert all(d is None or texts[d] == t for d, t in plain(unique)) and sum(d is None for d, _ in plain(unique)) == 2

    cut = cp.cut(stages["substrings"](spark, unique, folder), "t")
    want = cut_repeats([x for x in plain(unique) if x[0] is not None])
    left = {d: t for d, t in plain(cut) if d is not None}
    assert set(left) == {d for d, (n, gone, _) in want.items() if gone < n or not n}
    assert all(left[d] == (want[d][2] if want[d][1] else texts[d]) for d in left)
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())

    mix = cp.cut(stages["mixing"](spark, cut, folder), "t")
    passes = Counter({r.doc_id: int(np.ceil(r.taken / r.size)) for r in mixing.mix(cut).collect() if r.doc_id is not None and r.taken})
    assert Counter(r.doc_id for r in mix.collect() if r.doc_id is not None) == passes and max(passes.values()) <= 2
    assert mix.columns == cp.COLUMNS

    pieces = stages["packing"](spark, mix, folder).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in plain(mix))
    assert sum(r.length for r in pieces) == tokens > 0
    assert Counter(r.doc_id for r in pieces if r.start == 0 and r.doc_id is not None) == passes


def test_run_equals_its_stages(spark, folder):
    got = cp.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, folder), "t")
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r["count"] for r in got.groupBy("doc_id").count().collect()) == docs.count()
    assert sorted(map(tuple, got.groupBy("doc_id").sum("length").collect()), key=repr) == sorted(map(tuple, docs.groupBy("doc_id").sum("length").collect()), key=repr)
    assert set(key) <= set(got.columns)


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert cp.run(spark, path).count() == 0
