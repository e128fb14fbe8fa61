"""Action normalisation as pure Column builders (X1 formalize, X2 recover).

Both are ordered rule lists, first match wins, no match is null.  Each rule
becomes one ``when`` branch, so the whole thing stays a single JVM-side
expression inside whole-stage codegen.  Run them on *distinct* actions and
join back when the table is large (see ``operators.actions``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FORMALIZE_RULES, RECOVER_RULES


def py_strip(c: Column) -> Column:
    """``str.strip()``: every python whitespace character, both ends."""
    from .text import py_strip as strip
    return strip(c)


def _apply_rule(c: Column, pattern: str, fmt: str, nargs: int) -> tuple[Column, Column]:
    """Return (condition, value) of one rule.

    A regex rule is an ``rlike`` test plus one ``regexp_replace`` whose
    pattern also swallows the rest of the text (``[\\s\\S]*``), so a match
    yields exactly the formatted groups in one pass (no per-group extract)."""
    if nargs == 0:
        return py_strip(c) == F.lit(pattern.strip()), F.lit(fmt)
    repl = fmt.replace("$", "\\$")
    for g in range(1, nargs + 1):
        repl = repl.replace("{}", f"${g}", 1)
    return c.rlike(pattern), F.regexp_replace(c, pattern + r"[\s\S]*$", repl)


def _rule_chain(c: Column, rules) -> Column:
    out = None
    for pattern, fmt, nargs in rules:
        cond, val = _apply_rule(c, pattern, fmt, nargs)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out  # no otherwise: unmatched -> null


def _dispatched(c: Column, rules, head: Column, head_of) -> Column:
    """Same result as the ordered rule chain, evaluated cheaply.

    Regex rules are anchored at a literal first word, so only the rules of
    the row's own first word (``head``) can match: one ``CASE`` on the word
    picks that short ordered sub-chain instead of running every regex.
    Exact (zero-argument) rules compare the stripped text; no text equal to
    one of them can also match a regex rule (those need the word, a space
    or parenthesis and at least one more character), so trying them only
    when no regex rule matched keeps first-match-wins; ``coalesce`` is lazy,
    so the strip runs only for those rows."""
    groups: dict[str, list] = {}
    for p, f, n in rules:
        if n:
            groups.setdefault(head_of(p), []).append((p, f, n))
    exact_rules = [(p.strip(), f) for p, f, n in rules if n == 0]
    stripped = py_strip(c)
    exact = None
    for x, f in exact_rules:
        exact = F.when(stripped == x, F.lit(f)) if exact is None else exact.when(stripped == x, F.lit(f))
    out = None
    for h, rs in groups.items():
        chain = _rule_chain(c, rs)
        out = F.when(head == h, chain) if out is None else out.when(head == h, chain)
    return F.coalesce(out, exact)


def formalize(c: Column | str) -> Column:
    """``pick up apple`` -> ``PICK(apple)``; unmatched -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return _dispatched(c, FORMALIZE_RULES, F.substring_index(c, " ", 1),
                       lambda p: p[1:].split(" ")[0])


def recover(c: Column | str) -> Column:
    """``PICK(apple)`` -> ``pick up apple``; unmatched (e.g. ``END_SG()``) -> null."""
    c = F.col(c) if isinstance(c, str) else c
    return _dispatched(c, RECOVER_RULES, F.substring_index(c, "(", 1),
                       lambda p: p[1:].split("\\(")[0])


def formalize_chain(c: Column | str) -> Column:
    """The plain ordered chain (reference formulation, used in tests)."""
    c = F.col(c) if isinstance(c, str) else c
    return _rule_chain(c, FORMALIZE_RULES)


def recover_chain(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return _rule_chain(c, RECOVER_RULES)


def formal_verb(c: Column | str) -> Column:
    """Verb of a formal action: text before the first ``(``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^([A-Z_]+)\(", 1)


# --- SQL text of the same rules (used by the DuckDB oracle) -----------------

def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_sql(expr: str, rules) -> str:
    branches = []
    for pattern, fmt, nargs in rules:
        if nargs == 0:
            cond = f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g') = {_sql_str(pattern.strip())}"
            val = _sql_str(fmt)
        else:
            pieces = fmt.split("{}")
            parts = []
            for g, lit in enumerate(pieces):
                if lit:
                    parts.append(_sql_str(lit))
                if g < nargs:
                    parts.append(f"regexp_extract({expr}, {_sql_str(pattern)}, {g + 1})")
            cond = f"regexp_matches({expr}, {_sql_str(pattern)})"
            val = "concat(" + ", ".join(parts) + ")"
        branches.append(f"when {cond} then {val}")
    return "(case " + " ".join(branches) + " end)"


def formalize_sql(expr: str) -> str:
    return rules_sql(expr, FORMALIZE_RULES)


def recover_sql(expr: str) -> str:
    return rules_sql(expr, RECOVER_RULES)
