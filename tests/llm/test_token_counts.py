"""Operator 13 against the libraries' own whole-text encoding."""

import random

import pytest

from corpus import DOCS, documents, mixed_corpus
from trajframe.llm import token_counts
from trajframe.llm.token_counts import CACHE, Counter, count_tokens, tokenizer_path, version_of

PARTS = ["a", "word", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'", "<|endoftext|>", "<|", "é", "é", "\xa0", "　", "\x85", "\x1c", "​", "12", "½",
         "!", "...", "日本", "😀", " \n ", "_", "A", "Straße", "<|ENDOFTEXT|>"]


def plain(name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text or ""))
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text or "", add_special_tokens=False).ids)


def mixed_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(25))) for _ in range(n)]


def test_pieces_equal_whole_texts(monkeypatch):
    count, want = Counter(tokenizer_path()), plain("byte_bpe_50k.json")
    assert count.by_pieces
    for stretch in (1 << 22, 20):
        monkeypatch.setattr(token_counts, "STRETCH", stretch)
        for text in mixed_texts(4000, 1) + ["x" * 70 + " y" * 90, ""]:
            assert count.of(text) == want(text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_every_row(spark, name):
    rows = mixed_corpus(30) + [(2000 + i, t) for i, t in enumerate(mixed_texts(200, 2))] + [(None, "Null id."), (None, None), (None, "Null id.")]
    want = plain(name)
    got = count_tokens(documents(spark, rows).repartition(4), tokenizer_path(name)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        ((d, len((t or "").encode()), want(t), want(t) > 1024) for d, t in rows), key=repr)


def test_only_distinct_misses_are_encoded_and_appended(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path(), str(tmp_path / "cache")
    folder = f"{cache}/tokenizer={version_of(path)}"
    first = [(i, f"text number {i % 7}") for i in range(50)]
    count_tokens(documents(spark, first), path, cache=cache).collect()
    assert spark.read.schema(CACHE).parquet(folder).count() == 7
    more = first + [(100 + i, f"text number {i}") for i in range(9)] + [(1, None), (1, None)]
    got = count_tokens(documents(spark, more), path, cache=cache, limit=3).collect()
    want = plain("byte_bpe_50k.json")
    assert sorted(map(tuple, got), key=repr) == sorted(((d, len((t or "").encode()), want(t), want(t) > 3) for d, t in more), key=repr)
    assert spark.read.schema(CACHE).parquet(folder).count() == 10
    # a stored count is taken as it stands, and repeated rows of a cache count once
    spark.sql("select unhex(sha2('stored', 256)) as content, 77L as n_tokens from range(2)").write.mode("append").parquet(folder)
    assert [tuple(r) for r in count_tokens(documents(spark, [(5, "stored")]), path, cache=cache).collect()] == [(5, 6, 77, False)]
    # another version has counts of its own
    assert version_of(tokenizer_path("word_bpe_49k.json")) != version_of(path)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], DOCS)).collect() == []


def test_keys_of_normalising_tokenizers():
    c = Counter(tokenizer_path("word_bpe_49k.json"))
    assert c.normalised("A  B\n") == c.normalised("a b ") != c.normalised("a  c")
    assert c.normalised("<|endoftext|>") != c.normalised("<|ENDOFTEXT|>")
