"""Text column builders (X3-X12) used inside the table jobs.

All are pure ``Column -> Column`` functions built from Spark SQL built-ins,
so they stay JVM-side and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import DROPPED_PHRASES, ROOMS, SANITIZE_PHRASES, SANITIZE_SEPARATORS


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_lit(c: Column, search: str, repl: str) -> Column:
    return F.replace(c, F.lit(search), F.lit(repl))


def sanitize(c: Column | str) -> Column:
    """Line breaks/tabs -> `` | ``, then the fixed phrase fixes. Null-safe."""
    out = _c(c)
    for a, b in SANITIZE_SEPARATORS + SANITIZE_PHRASES:
        out = replace_lit(out, a, b)
    return out


def clean_ws(c: Column | str) -> Column:
    """Newline and tab -> space."""
    return F.translate(_c(c), "\n\t", "  ")


def drop_phrases(c: Column | str) -> Column:
    """Remove ``(that is open)`` and ``(containing nothing)``."""
    out = _c(c)
    for p in DROPPED_PHRASES:
        out = replace_lit(out, p, "")
    return out


# python's str.isspace() characters
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(x) for x in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c: Column | str, chars: str | None = None) -> Column:
    """``str.strip()`` (python whitespace) or ``str.strip(chars)``: ``btrim``
    with the character set, no regex."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE if chars is None else chars))


def observation_room(obs: Column | str) -> Column:
    """Room named in a move observation: text after ``move to the `` minus the
    last character, stripped; null when the phrase is absent."""
    obs = _c(obs)
    idx = F.instr(obs, "move to the")
    n = F.length(obs) - idx - 12
    return F.when(idx > 0, py_strip(F.when(n > 0, F.substring(obs, idx + 12, F.greatest(n, F.lit(0)))).otherwise(F.lit(""))))


def look_room(look: Column | str) -> Column:
    """Room of a look text: chars 24.. after ``This room is called the`` up to
    the first ``.`` of the whole text (python slice semantics); null if absent."""
    look = _c(look)
    start = F.instr(look, "This room is called the") - 1  # 0-based, -1 when absent
    dot = F.instr(look, ".") - 1
    end = F.when(dot >= 0, dot).otherwise(F.length(look) - 1)
    n = end - (start + 24)
    return F.when(
        start >= 0,
        F.when(n > 0, F.substring(look, start + 25, F.greatest(n, F.lit(0)))).otherwise(F.lit("")),
    )


def object_mentions(look: Column | str) -> Column:
    """Ordered list of object names mentioned in a look text.

    ``, . (`` become line ends, ``)`` a space and `` an `` ``a``; every
    case-insensitive ``a .*?\\n`` is a mention; mentions containing ``door``
    are skipped; tabs/newlines become spaces, then whitespace and dots are
    stripped."""
    t = _c(look)
    for a, b in [(",", "\n"), (".", "\n"), ("(", "\n"), (")", " "), (" an ", " a ")]:
        t = replace_lit(t, a, b)
    things = F.regexp_extract_all(t, F.lit("(?i)a .*?\\n"), F.lit(0))
    kept = F.filter(things, lambda x: ~x.contains("door"))
    return F.transform(kept, lambda x: py_strip(py_strip(clean_ws(x)), "."))


def strip_generation(c: Column | str) -> Column:
    """The text between ``<extra_id_0>`` and ``<extra_id_1>`` when the
    whole line matches ``.*<extra_id_0>(.*)<extra_id_1>.*`` (greedy), else
    the text itself; then ``<`` starts a new token, tokens starting with
    ``<`` are dropped and the rest re-joined with single spaces."""
    c = _c(c)
    pat = r"^.*<extra_id_0>(.*)<extra_id_1>"
    body = F.when(c.rlike(pat), F.regexp_extract(c, pat, 1)).otherwise(c)
    toks = F.split(F.replace(body, F.lit("<"), F.lit(" <")), " ")
    toks = F.filter(toks, lambda x: (py_strip(x) != "") & ~x.startswith("<"))
    return py_strip(F.array_join(toks, " "))


def first_word(c: Column | str) -> Column:
    """First whitespace token of the trimmed text."""
    return F.split(py_strip(_c(c)), r"\s+").getItem(0)


def tokens(c: Column | str) -> Column:
    """Split on single spaces (``str.split(" ")``)."""
    return F.split(_c(c), " ")


def rooms_array() -> Column:
    return F.array(*[F.lit(r) for r in ROOMS])


def current_room(look: Column | str) -> Column:
    """First listed room r whose ``called the r`` is in the first sentence."""
    first_sentence = F.split(_c(look), r"\.").getItem(0)
    hits = F.filter(rooms_array(), lambda r: first_sentence.contains(F.concat(F.lit("called the "), r)))
    return F.try_element_at(hits, F.lit(1))


def focus_targets(task: Column | str, find: bool = True) -> Column:
    """Word runs after ``focus on`` and (``find``) after ``find`` (``a(n)`` read as
    ``a``) in the task text, ``the `` replaced by a space, stripped."""
    t = _c(task)
    word_run = r"\s+(\w+(?:\s+\w+)*)"
    focus = F.regexp_extract_all(t, F.lit("focus on" + word_run), F.lit(1))
    if find:
        focus = F.concat(focus, F.regexp_extract_all(F.replace(t, F.lit("a(n)"), F.lit("a")), F.lit("find" + word_run), F.lit(1)))
    return F.transform(focus, lambda x: py_strip(F.replace(x, F.lit("the "), F.lit(" "))))


def truncate_tokens(c: Column | str, n: int) -> Column:
    """X12 (re-aimed): keep the first ``n`` whitespace tokens."""
    return F.array_join(F.slice(F.split(py_strip(_c(c)), r"\s+"), 1, n), " ")


def _is_alpha_or_space_prefix_len(line: Column) -> Column:
    """Index of the first char that is neither a letter nor a space (-1 if none)."""
    m = F.regexp_extract(line, r"^([\p{L} ]*)", 1)
    return F.when(F.length(m) == F.length(line), F.lit(-1)).otherwise(F.length(m))


def clean_look(look: Column | str, lite: bool = False) -> Column:
    """Look text up to ``You also see:``, one entry per non-blank line;
    ``In it, you see:`` lines only in the full form; lines with ``the agent``
    or `` air`` dropped; ``substance called `` -> space, stripped.  Lite form
    cuts each line at its first non-letter/non-space char and joins with
    ``, ``; the full form joins with ``\\n \\t - ``."""
    t = _c(look)
    cut = F.when(F.instr(t, "You also see:") > 0, F.substring_index(t, "You also see:", 1)).otherwise(t)
    lines = F.split(cut, r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]")
    lines = F.filter(lines, lambda x: py_strip(x) != "")
    if lite:
        lines = F.filter(lines, lambda x: ~x.contains("In it, you see:"))
    lines = F.filter(lines, lambda x: x.contains("In it, you see:") | ~(x.contains("the agent") | x.contains(" air")))
    lines = F.transform(lines, lambda x: F.when(x.contains("In it, you see:"), x)
                        .otherwise(py_strip(F.replace(x, F.lit("substance called "), F.lit(" ")))))
    if lite:
        def cut_line(x):
            i = _is_alpha_or_space_prefix_len(py_strip(x))
            return F.when(i > 0, py_strip(F.substring(py_strip(x), 1, i))).otherwise(x)
        lines = F.transform(lines, cut_line)
        return F.array_join(lines, ", ")
    return F.array_join(lines, "\n \t - ")
