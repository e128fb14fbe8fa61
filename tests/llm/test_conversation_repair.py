"""Operator 12 against a plain search over the lattice."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from trajframe.llm.conversation_repair import ACCEPT, cheapest, damaged, repair_conversations, repair_damaged

SPACE = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string, digest string, gaps string, part string, audit string"


def accepted(roles: str) -> bool:
    roles = roles[1:] if roles[:1] == "s" and len(roles) > 1 else roles
    return len(roles) % 2 == 0 and roles == "ua" * (len(roles) // 2)


def every_repair(rows, most):
    """(cost, audit, roles) of all edit sequences that cost at most ``most``, whatever roles they give."""
    def go(i, cost, audit, roles):
        if cost > most:
            return
        if i == len(rows):
            yield cost, audit, roles
        for new in "ua":
            yield from go(i, cost + 3, audit + "I", roles + new)
        if i < len(rows):
            initial, fault = rows[i]
            yield from go(i + 1, cost + 4, audit + "D", roles)
            if fault != 1:
                more = 3 if fault == 2 else 0
                yield from go(i + 1, cost + more, audit + "K", roles + (initial or "?"))
                for new in "ua":
                    yield from go(i + 1, cost + 3 + more, audit + "R", roles + new)
    return go(0, 0, "", "")


def test_cheapest_audit_among_all_edit_sequences():
    r = random.Random(5)
    for _ in range(250):
        rows = [(r.choice("ssuuaax") if r.random() < 0.95 else "", r.choice([0, 0, 0, 1, 2])) for _ in range(r.randrange(0, 5))]
        cost, audit = cheapest(rows)
        plain = min((c, a) for c, a, roles in every_repair(rows, cost) if accepted(roles))
        assert (cost, audit) == plain, rows


def walk(rows):
    """Least (cost, audit, repaired lines) row by row, from every state to every state."""
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    forced = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def filled(best):
        for _ in range(2):
            for s, (c, a, out) in list(best.items()):
                t, role = forced[s]
                best[t] = min(best.get(t, (10**9,)), (c + 3, a + "I", out + (role + ":",)))
        return best
    best = {0: (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for s, (c, a, out) in filled(best).items():
            t, other = forced[s]
            more = 3 if fault == "truncated" else 0
            steps = [(s, (c + 4, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                steps.append((t, (c + 3 + more, a + "R", out + (other + ":" + text,))))
                if (role[:1], s) in after:
                    steps.append((after[role[:1], s], (c + more, a + "K", out + (role + ":" + text,))))
            for to, label in steps:
                new[to] = min(new.get(to, (10**9,)), label)
        best = new
    return min(v for s, v in filled(best).items() if s in ACCEPT)


def plain(rows):
    """What the operator gives for (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda x: x[:4])
        seen, kinds, judged = set(), [], []
        for _, _, role, _, text in own:
            body = text.rstrip(SPACE)
            kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append(kind)
            judged.append((role, text, kind))
        turns = {t for has, t, *_ in own if has}
        first = [r[:1] for r, _, _ in judged]
        cost, audit, lines = walk(judged)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                     sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def corpus(n=40, seed=2):
    r = random.Random(seed)
    texts = ["Hello there.", "Hi!", "What now?", "cut off", "", " \t", "Well. ", "é…", None, "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        length = r.choice([1, 2, 3, 5, 9, 40])
        for turn in range(length):
            rows.append((conv if conv else None, r.choice([turn, turn, turn + 1, None if r.random() < 0.2 else turn * 2]),
                         r.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), r.choice(texts) if r.random() < 0.4 else f"Number {r.randrange(30)}."))
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "d", "g", "p", "a") for x in rows], TURNS)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("block", [256, 4])
def test_conversations_short_and_in_blocks(spark, block):
    rows = corpus()
    got = repair_conversations(frame(spark, rows).repartition(5), block=block).collect()
    want = plain(rows)
    assert {r["conv_id"]: tuple(r[c] for c in FIGURES) for r in got if r["last"]} == want
    parts = defaultdict(dict)
    for r in got:
        parts[r["conv_id"]][r["part"]] = r["repaired"]
    for r in got:
        if r["last"]:
            text = "".join(parts[r["conv_id"]][i] for i in range(r["part"] + 1))
            assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]


def test_one_conversation_of_many_rows_and_long_texts(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", ("long " * 400_000 if i == 11 else f"Line {i // 3 if i % 5 == 0 else i}") + ".") for i in range(900)]
    got = [r for r in repair_conversations(frame(spark, rows)).collect() if r["last"]]
    assert {r["conv_id"]: tuple(r[c] for c in FIGURES) for r in got} == plain(rows)


def test_damage_and_every_original_id(spark):
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], ["Yes. No.", None, "ok"][t % 3]) for c in range(60) for t in range(c % 5 + 1)]
    rows += [(None, None, "user", "Alone."), (99, None, None, None)]
    want = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            want += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    got = [tuple(r) for r in damaged(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    expected = {c: nothing for c, *_ in rows} | plain(want)
    assert {r["conv_id"]: tuple(r[c] for c in FIGURES) for r in repair_damaged(frame(spark, rows)).collect()} == expected


def test_empty_table(spark):
    assert repair_damaged(frame(spark, [])).collect() == []
    assert repair_conversations(frame(spark, [])).collect() == []
