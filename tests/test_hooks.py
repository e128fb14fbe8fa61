"""Caller-supplied models: tokenizers (X12) and embeddings."""

import os
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from trajframe.functions.hooks import embed_texts, library_tokenizer, over_limit, truncate_by_tokenizer
from trajframe.operators import joins as J
from trajframe.plans.q_match import hash_embedding
from trajframe.plans.views import v_f_plain


def test_truncation_equals_the_library_on_whole_texts(spark):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = str(files.path("byte_bpe_50k.json"))
    model = tokenizers.Tokenizer.from_file(path)
    texts = [None, "", "go to kitchen", "é 日本 😀 <|endoftext|> x", "word " * 3000, "same", "same"] + [r.freelook for r in v_f_plain(spark, SF_SMALL).limit(200).collect()]
    df = spark.createDataFrame([(i, t, "tail") for i, t in enumerate(texts)], "id long, text string, other string").repartition(3)
    got = {r.id: r for r in truncate_by_tokenizer(df, {"text": 7}, library_tokenizer(path)).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids
        r = got[i]
        assert (r.text_tokens, r.text_over, r.other) == (len(ids), len(ids) > 7, "tail")
        assert r.text == ((t or "") if len(ids) <= 7 else model.decode(ids[:7], skip_special_tokens=False))
    report = over_limit(truncate_by_tokenizer(df, {"text": 7}, library_tokenizer(path)), ["text"]).first()
    assert (report.rows, report.text_over, report.text_longest) == (len(texts), sum(r.text_over for r in got.values()), max(r.text_tokens for r in got.values()))


def test_pieces_give_the_ids_of_whole_texts():
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = str(files.path("byte_bpe_50k.json"))
    model, (encode, decode) = tokenizers.Tokenizer.from_file(path), library_tokenizer(path)()
    drawn, parts = random.Random(3), [*"ab's 1,.\n\t<|>é日😀", "  ", "word ", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "<|endoftext|>", "'ll", "x" * 60]
    texts = ["".join(drawn.choices(parts[:n], k=drawn.randrange(30))) for n in (8, 18, len(parts)) for _ in range(500)]
    ids = [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    assert encode(texts) == ids and encode(texts) == ids
    ids = [i[:n] for i in ids for n in (1, 3, 9)] + [drawn.choices(range(50257), k=6) for _ in range(500)]
    assert list(map(decode, ids)) == [model.decode(i, skip_special_tokens=False) for i in ids]


def test_a_known_piece_is_not_encoded_again(monkeypatch):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    given = []

    class Counting:
        def __init__(self, model):
            self.model = model

        @classmethod
        def from_file(cls, path):
            return cls(model)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.model.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(self.model, name)

    path = str(files.path("byte_bpe_50k.json"))
    model = tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    encode, _ = library_tokenizer(path)()
    encode([f"{i} go to the kitchen, look around and open the door" for i in range(300)])
    assert len(given) == len(set(given)) and sum(map(len, given)) < 2000      # 300 texts of 50 characters


def test_every_distinct_text_is_embedded_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def hook():
        inner = hash_embedding()

        def embed(texts):
            with open(f"{asked}-{os.getpid()}", "a") as f:
                f.writelines(t + "\n" for t in texts)
            return inner(texts)
        return embed

    preds = spark.createDataFrame([(1, i, f"p{i % 4}") for i in range(9)] + [(2, 1, "shared"), (3, 1, None)], "g long, rank int, action string")
    cands = spark.createDataFrame([(1, f"c{i % 5}") for i in range(20)] + [(1, "p0"), (2, "shared"), (2, "c1")], "g long, action string").repartition(4)
    got = J.nearest_by_text(preds, cands, ["g"], hook, n=3, rank="rank")
    first = sorted(map(tuple, got.collect()))
    assert sorted(map(tuple, got.collect())) == first
    said = [x for f in os.listdir(tmp_path) for x in open(tmp_path / f).read().split()]
    assert sorted(said) == sorted({"p0", "p1", "p2", "p3", "shared", "c0", "c1", "c2", "c3", "c4"})
    best = {r.g: r for r in got.where("chosen").collect()}
    assert best[2].action == "shared" and best[2].score == pytest.approx(1.0) and set(best) == {1, 2}
    assert got.where("g = 1").count() == 3


def test_embeddings_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "t string")
    got = embed_texts(df, hash_embedding, "t")
    assert sorted(r.t for r in got.collect()) == ["a", "b"] and got.where(F.size("embedding") != 8).count() == 0
