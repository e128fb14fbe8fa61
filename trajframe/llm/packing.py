"""Operator 1, cost-balanced packing of token ids into sequences.

A document's ids are those of a public tokenizer, then one end id.  A stretch of
``LENGTH`` ids is a sequence of its own; what is left of each document (its tail)
waits in a buffer of at most ``TAILS`` tails.  A buffer is packed at once: its ids
need ``m = ceil(ids / LENGTH)`` sequences; tails go in descending length to the
sequence of least cost, ``LINEAR * n + QUADRATIC * n * n`` summed over its pieces,
among those with room.  A tail that has room nowhere is cut into the room that is
left, cheapest sequence first.  So a buffer pads fewer than ``LENGTH`` ids in all.

Each task packs the documents it reads, as they come: no shuffle, one pass of the
tokenizer, memory bounded by the buffer and the longest text.  A lost task is run
again on the same split and gives the same rows.  ``sequence_id`` is the number
of the task and a counter.

Tokens are looked up by words (runs without ASCII white space, ASCII letters in
lower case), which is exact for tokenizers that lower-case and never join
characters across white space, as this one; words seen before are kept in a
bounded cache.

Defined cases: a null or empty text is its end id alone; repeated rows are
documents of their own; a null ``doc_id`` stays null; further columns are ignored."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, text_bytes

LENGTH, END_ID, TAILS = 2048, 1, 8192
#: Characters of text whose words are looked up together.
TOGETHER = 1 << 18
#: Cost of a piece of n tokens: the dense layers, and attention among its own tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
TOKENIZER = "word_bpe_49k.json"
END = np.array([END_ID], "<u4").tobytes()
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_cost double, ids array<int>")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class TokenIds:
    """Little-endian 32-bit ids of texts, looked up by words; the words seen are
    kept as bytes of ids and forgotten when they are many.  A word of ASCII letters that
    normaliser and splitter leave as it is goes to the tokenizer's model directly."""

    LIMIT = 1_000_000
    MARKS = b"!#$%&*,.?:;"
    LETTERS = b"abcdefghijklmnopqrstuvwxyz"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.direct = self._letters_stay()

    def _letters_stay(self) -> bool:
        """Whether normaliser and splitter leave a word of ASCII letters as it is."""
        t, word = self.tokenizer, self.LETTERS.decode()
        if any(not a.content.strip(word) for a in t.get_added_tokens_decoder().values()):
            return False
        return ((t.normalizer is None or t.normalizer.normalize_str(word) == word)
                and (t.pre_tokenizer is None or [w for w, _ in t.pre_tokenizer.pre_tokenize_str(word)] == [word]))

    def encode(self, new: list[bytes]) -> None:
        """Encode words: those of letters by the model, the others in one call."""
        if self.direct:
            letters, others = [], []
            for w in new:
                (others if w.translate(None, self.LETTERS) else letters).append(w)
            of, ids, ends = self.model.tokenize, [], [0]
            for w in letters:
                ids += [t.id for t in of(w.decode())]
                ends.append(len(ids) * 4)
            ids = np.array(ids, "<u4").tobytes()
            self.known.update(zip(letters, map(ids.__getitem__, map(slice, ends[:-1], ends[1:]))))
            new = others
        if new:
            self.encode_line(new)

    def encode_line(self, new: list[bytes]) -> None:
        """Encode words in one call; a token belongs to the word its first character lies in."""
        line = b" ".join(new).decode("utf-8", "replace")
        found = self.tokenizer.encode(line, add_special_tokens=False)
        sizes = np.fromiter(map(len, line.split(" ")), np.int64, len(new))
        at = np.searchsorted([a for a, _ in found.offsets], np.r_[0, np.cumsum(sizes + 1)]) * 4
        ids = np.asarray(found.ids, "<u4").tobytes()
        self.known.update(zip(new, (ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))))

    def learn(self, new) -> None:
        """Words of letters with marks behind are encoded as their two parts, which
        the tokenizer splits anyway, so that a word is encoded once for all its marks."""
        parts = [(w, w.rstrip(self.MARKS)) for w in new]
        parts = [(w, stem if stem != w and b"a" <= stem[-1:] <= b"z" else w) for w, stem in parts]
        wanted = {stem for _, stem in parts}
        wanted.update(w[len(stem):] for w, stem in parts if stem != w)
        if wanted := list(wanted.difference(self.known)):
            self.encode(wanted)
        known = self.known
        known.update([(w, known[stem] + known[w[len(stem):]]) for w, stem in parts if stem != w])

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text and the end id; the words that are new are learnt together."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        found, new = [], set()
        for text in texts:
            raw = text_bytes(text)
            # the tokenizer lower-cases all but its special tokens
            words = (raw if b"<|" in raw else raw.translate(UPPER_TO_LOWER)).split()
            new.update(set(words).difference(self.known))
            found.append(words)
        if new:
            self.learn(new)
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, words)) + END, "<u4") for words in found]


def stretches(texts: list[str | None], size: int):
    """Consecutive texts, up to ``size`` characters of them or one longer text."""
    some, held = [], 0
    for text in texts:
        if some and held + len(text or "") > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text or "")
    if some:
        yield some


_LOADED: dict[str, TokenIds] = {}


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents no longer
    than ``length``, by descending length to the cheapest sequence with room."""
    if not lengths:
        return []
    m = -(-sum(lengths) // length)
    room, price = np.full(m, length, np.int64), np.zeros(m)
    out = []
    for d in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[d]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            s = int(np.where(fits, price, np.inf).argmin())
            n = min(left, int(room[s]))
            out.append((d, start, n, s, length - int(room[s])))
            room[s] -= n
            price[s] += cost(n)
            start, left = start + n, left - n
    return out


def _pack(path: str, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        tokens = _LOADED.get(path) or _LOADED.setdefault(path, TokenIds(path))
        following = TaskContext.get().partitionId() << 40
        tails: list[tuple[int | None, np.ndarray, int, int]] = []

        def packed():
            nonlocal following
            placed = assign([len(t[1]) for t in tails])
            prices: dict[int, float] = {}
            for _, _, n, s, _ in placed:
                prices[s] = prices.get(s, 0.0) + cost(n)
            rows = []
            for d, start, n, s, offset in placed:
                doc, ids, first, total = tails[d]
                rows.append((doc, first + start, n, zlib.crc32(ids[start:start + n].tobytes()), total, following + s, offset, prices[s], ids[start:start + n]))
            following += len(prices)
            tails.clear()
            return rows

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64()] * 7 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            ids = pa.array([x.astype(np.int32) for x in columns[8]], pa.list_(pa.int32())) if with_ids else pa.nulls(len(rows), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*arrays, ids], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost", "ids"])

        for batch in batches:
            rows = []
            found = chain.from_iterable(map(tokens.of, stretches(batch.column("text").to_pylist(), TOGETHER)))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), found):
                whole = len(ids) // LENGTH * LENGTH
                for a in range(0, whole, LENGTH):
                    part = ids[a:a + LENGTH]
                    rows.append((doc, a, LENGTH, zlib.crc32(part.tobytes()), len(ids), following, 0, cost(LENGTH), part))
                    following += 1
                if whole < len(ids):
                    tails.append((doc, ids[whole:], whole, len(ids)))
                    if len(tails) >= TAILS:
                        rows += packed()
            yield batch_of(rows)
        yield batch_of(packed())
    return run


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, the
    cost of the sequence and (``with_ids``) its ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_pack(path or tokenizer_path(), with_ids), SCHEMA)
