import zlib
from collections import defaultdict

import numpy as np
from corpus import documents, mixed_corpus

from trajframe.llm import packing as pk


def test_pieces_rebuild_the_ids(spark):
    from tokenizers import Tokenizer
    rows = mixed_corpus() + [(2000, "l'été n'est-ce pas? <|endoftext|> 東京  café́ a b"), (None, "no id")]
    tokenizer = Tokenizer.from_file(pk.tokenizer_path())
    got = pk.pack(documents(spark, rows).repartition(3)).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= pk.LENGTH
    for d, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [pk.END_ID], "<u4")
        mine = sorted(pieces[d], key=lambda r: r.start)
        if d == 1007:                              # repeated rows: every id twice
            assert sum(r.length for r in mine) == 2 * len(ids)
            continue
        at = 0
        for r in mine:
            part = ids[at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(part.tobytes()), part.tolist())
            at += r.length
        assert at == len(ids)
    padding = sum(pk.LENGTH - sum(n for _, n in places) for places in sequences.values())
    assert padding < 3 * pk.LENGTH                 # each of three partitions pads fewer than LENGTH ids


def test_descending_to_the_cheapest():
    placed = pk.assign([10, 6, 6, 4, 4, 2], 16)
    assert [(d, s) for d, _, _, s, _ in placed] == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 1), (5, 0)]
    placed = pk.assign([9, 9, 9, 5], 16)           # 32 ids in two sequences: the third document is cut
    assert sum(n for _, _, n, _, _ in placed) == 32 and sorted({s for *_, s, _ in placed}) == [0, 1]
    assert pk.assign([]) == []


def test_empty_table(spark):
    assert pk.pack(documents(spark, [(1, "a")]).where("doc_id < 0")).collect() == []


def test_letter_words_skip_the_splitter_and_texts_learn_together():
    tokens, lines = pk.TokenIds(pk.tokenizer_path()), []
    line = tokens.encode_line
    tokens.encode_line = lambda new: (lines.append(new), line(new))
    texts = ["Der Hund, the dog! don't stop", None, "", "l'\u00e9t\u00e9 abc123 <|endoftext|> Z\u0130", "the dog, na\u00efve " * 50, "x" * 5000]
    got = tokens.of(texts)
    for ids, text in zip(got, texts, strict=True):
        assert ids.tolist() == tokens.tokenizer.encode(text or "", add_special_tokens=False).ids + [pk.END_ID]
    assert len(lines) == 1 and not any(w.isascii() and w.isalpha() for w in lines[0])
    assert [x.tolist() for x in tokens.of(texts)] == [x.tolist() for x in got] and len(lines) == 1
    assert list(pk.stretches(["ab", None, "c", "defgh", ""], 3)) == [["ab", None, "c"], ["defgh"], [""]]


def test_letters_are_not_sent_directly_where_they_are_split(tmp_path):
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers
    whole = Tokenizer.from_file(pk.tokenizer_path())
    whole.normalizer = normalizers.Sequence([whole.normalizer, normalizers.Replace("e", "a")])
    whole.save(str(tmp_path / "normalised.json"))
    split = Tokenizer.from_file(pk.tokenizer_path())
    split.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[a-m]+"), "isolated"), split.pre_tokenizer])
    split.save(str(tmp_path / "split.json"))
    for name, tokenizer in (("normalised", whole), ("split", split)):
        tokens = pk.TokenIds(str(tmp_path / f"{name}.json"))
        assert not tokens.direct
        assert tokens.of(["the letter stays"])[0].tolist() == tokenizer.encode("the letter stays", add_special_tokens=False).ids + [pk.END_ID]
