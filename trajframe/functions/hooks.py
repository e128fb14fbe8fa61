"""Caller-supplied models as batch hooks: tokenizers for X12, embeddings
for J6.  A hook is a factory without arguments; it is called once in each Python
worker that needs it, and what it returns works on whole batches of texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Texts whose token ids a worker remembers, and their greatest length.
REMEMBERED, SHORT = 200_000, 200
#: Greatest length of a remembered piece.  A piece is ASCII white space and what follows
#: up to the next.  Other white space, with the separators 1C-1F; any but the space.
LONGEST = 48
PIECES = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
WIDE = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE, NOT_PLAIN = re.compile(f"[{WIDE}]"), re.compile(f"[\\t-\\r{WIDE}]")


def cuts_at_space(path: str) -> bool:
    """Whether a ``tokenizers`` file starts a new piece wherever white space follows
    another character, so that a text's ids are those of its pieces in a row, and whose
    tokens stand for bytes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    return (not spec.get("normalizer") and (spec.get("decoder") or {}).get("type") == "ByteLevel" and not spec["model"].get("dropout")
            and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []))


class _Known(dict):
    """Ids of ``before`` and a piece; what is missing is encoded, long pieces are forgotten."""

    def __init__(self, encode: Callable, before: str = ""):
        self.encode, self.before = encode, before

    def of(self, pieces: list[str]) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        new = list(set(pieces).difference(self))
        if new:
            self.update(zip(new, self.encode([self.before + p for p in new])))
        ids = list(chain.from_iterable(map(self.__getitem__, pieces)))
        for p in new:
            if len(p) > LONGEST:
                del self[p]
        return ids


def by_pieces(encode: Callable) -> Callable:
    """``encode`` for a tokenizer that cuts at space: short pieces are encoded once and
    looked up.  At most two spaces in a row, with text behind, part before each of them;
    texts that hold white space outside ASCII are encoded whole."""
    known, spaced = _Known(encode), _Known(encode, " ")

    def ids_of(text: str) -> list[int]:
        if "   " not in text and not text.endswith("  ") and not NOT_PLAIN.search(text):
            first, *rest = text.split(" ")
            return known.of([first]) + spaced.of(rest)
        return known.of([text] if OTHER_SPACE.search(text) else PIECES.findall(text))

    return lambda texts: list(map(ids_of, texts))


class _TokenBytes(dict):
    """Bytes of the tokens of a byte-level vocabulary, by id."""

    PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
    BYTE = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(PRINTED)))}

    def __init__(self, model):
        self.model = model

    def __missing__(self, i: int) -> bytes:
        token = self.model.id_to_token(i) or ""
        found = [self.BYTE.get(c) for c in token]
        self[i] = token.encode() if None in found else bytes(found)
        return self[i]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.__getitem__, ids)).decode("utf-8", "replace")


def library_tokenizer(path: str) -> Callable[[], tuple[Callable, Callable]]:
    """Hook of a ``tokenizers`` file: ``encode(texts) -> ids``, ``decode(ids) -> text``;
    no special tokens are added, no truncation is done by the library.  Where the file
    allows it, texts are encoded by pieces, which gives the same ids."""
    def load():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        def encode(texts):
            return [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        if cuts_at_space(path):
            return by_pieces(encode), _TokenBytes(model).decode
        return encode, lambda ids: model.decode(ids, skip_special_tokens=False)
    return load


def _truncated(limits: dict[str, int], hook, names: list[str]):
    def run(batches):
        encode, decode = hook()
        known: dict[str, list[int]] = {}
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for name, most in limits.items():
                texts = ["" if x is None else x for x in columns[name].to_pylist()]
                new = list({x for x in texts if x not in known})
                ids = dict(zip(new, encode(new)))
                kept = {x: known[x] if x in known else ids[x] for x in set(texts)}
                cut_at = {x: decode(i[:most]) if len(i) > most else x for x, i in kept.items()}
                columns[name] = pa.array([cut_at[x] for x in texts], pa.string())
                columns[f"{name}_tokens"] = pa.array([len(kept[x]) for x in texts], pa.int64())
                columns[f"{name}_over"] = pa.array([len(kept[x]) > most for x in texts], pa.bool_())
                if len(known) > REMEMBERED:
                    known.clear()
                known.update((x, i) for x, i in ids.items() if len(x) <= SHORT)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)
    return run


def truncate_by_tokenizer(df: DataFrame, limits: dict[str, int], hook: Callable) -> DataFrame:
    """X12 with a tokenizer: each text column of ``limits`` keeps what its first tokens
    decode to, at most the limit, texts within it stay as they are; ``<column>_tokens``
    counts the whole text and ``<column>_over`` reports what was cut.  A null text
    reads as empty.  Whole texts are encoded, in batches; a worker remembers the
    ids of short texts, which come again."""
    schema = T.StructType([f for f in df.schema.fields])
    for name in limits:
        schema = schema.add(f"{name}_tokens", T.LongType()).add(f"{name}_over", T.BooleanType())
    names = [f.name for f in schema.fields]
    return df.mapInArrow(_truncated(limits, hook, names), schema)


def over_limit(truncated: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Report of X12: rows, rows cut and the longest text in tokens of each column."""
    sums = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        sums += [F.count_if(F.col(f"{c}_over")).alias(f"{c}_over"), F.max(f"{c}_tokens").alias(f"{c}_longest")]
    return truncated.groupBy(*by).agg(*sums)


def _embedded(hook, name: str):
    def run(batches: Iterable[pa.RecordBatch]):
        embed = hook()
        for batch in batches:
            texts = batch.column(name).to_pylist()
            if texts:
                vectors = [[float(x) for x in v] for v in embed(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], [name, "embedding"])
    return run


def embed_texts(texts: DataFrame, hook: Callable, column: str) -> DataFrame:
    """``column, embedding`` of every distinct text, each given to the hook once (the
    result is written, so nothing that reads it asks again).  ``hook() -> embed``,
    ``embed(texts) -> vectors`` of one length."""
    one = texts.where(F.col(column).isNotNull()).select(column).distinct()
    return cut(one.mapInArrow(_embedded(hook, column), f"`{column}` string, embedding array<double>"), "embedded")
