"""Small tables and plain-Python versions of the corpus operators."""

from __future__ import annotations

import random
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, sig string, _score string"


def documents(spark, rows):
    """rows of (doc_id, text[, source]); further columns have names that the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", "s", "g", "c") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def mixed_corpus(n: int = 60, seed: int = 1):
    """Texts with exact and near copies, shared passages, ties, blanks and nulls."""
    r = random.Random(seed)
    passage = prose(999, 60)
    rows = []
    for i in range(n):
        words = prose(seed * 1000 + i, r.randrange(20, 200))
        if i % 7 == 3:
            at = r.randrange(len(words))
            words[at:at] = passage[r.randrange(0, 20):r.randrange(40, 60)]
        if i % 5 == 4:                                   # a near copy of an earlier text
            words = rows[r.randrange(len(rows))][1]
            words = (words or "x").split()
            if i % 10 == 9:
                for _ in range(max(1, len(words) // 40)):
                    words[r.randrange(len(words))] = f"new{i}"
        rows.append((i * 3 % (n * 2 + 1), " ".join(words) if i % 4 else "\t" + "  \n".join(words).upper() + " "))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE two"), (1005, "a b c d e"),
             (1006, "long " * 30000 + "end"), (1007, rows[0][1]), (1007, rows[0][1])]
    return rows


def closed(n_links: dict, pairs) -> dict:
    """Smallest id reachable by pairs."""
    parent = {d: d for d in n_links}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in n_links}


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def shingle_sets(rows):
    sets = {}
    for d, text in rows:
        w = split(lower_ascii(text or ""))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def near_components(rows):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, closed(sets, pairs)


def cut_repeats(rows, window=13):
    starts = {}
    texts = {d: split(t) for d, t in rows}
    for d in sorted(texts):
        for i in range(len(texts[d]) - window + 1):
            starts.setdefault(tuple(texts[d][i:i + window]), d)
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def by_id(rows, key="doc_id"):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
