"""Operator 12, conversation structure repair by bidirectional Dijkstra.

A conversation's rows, in order of turn, are repaired to roles that read
``(s?(ua)+)?`` by their initials.  A node of the edit lattice is (rows consumed,
state of that pattern); edges keep a row (0), give it the role user or assistant
(3), delete it (4) or insert an empty message (3); a truncated row that stays
costs 3 more, a blank or repeated row can only be deleted.  A forward heap from
the start and a reverse heap from the accepting ends each settle the node of
least cost; every label is the least audit (the edits' initials) of its cost.
Heaps go by cost and, at equal cost, by rows consumed, so a node is settled after
all that can still improve its label.  When the two tops together exceed the best
crossing, all crossings of that cost have both labels, and the least concatenated
audit wins.  Two paths of one cost to one node are never prefixes of each other
(an insertion costs), so least parts give the least whole.

* Conversations of up to ``BLOCK`` rows lie in one task.
* Longer ones are sorted by range, so that many tasks share one conversation, and
  cut into blocks of ``BLOCK`` rows; each block gives the cheapest audit for every
  state it may begin and end in, and the blocks are chained in order, of which only
  four costs and what follows the audits' common beginning are held.  The first
  occurrence of each message comes from an aggregate.  The repaired text streams
  through one task, as its SHA-256 is one sequence; no conversation is held whole.

Defined cases: null roles and texts count as one space, null turns come first, a
null ``conv_id`` is a conversation of its own; rows of equal turn are taken by role,
then by digest of the message; repeated rows are duplicates; a conversation
without rows has no result (the query adds it); texts of any length are handled row
by row; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import hashlib
import heapq
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK, FEW, PART = 256, 100_000, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after the system, after a user, after an assistant.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE = {2: "user", 3: "assistant"}
ACCEPT = (0, 3)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FINE, GONE, CUT_OFF = 0, 1, 2
FIGURES = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
RESULT = ("conv_id long, part int, repaired string, last boolean, repaired_sha256 string, "
          "blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def edges(row: tuple[str, int], state: int):
    """(next state, cost, initial) of the edits of a row."""
    initial, fault = row
    yield state, DELETE, "D"
    if fault != GONE:
        more = TRUNCATED if fault == CUT_OFF else 0
        if state in AFTER.get(initial, ()):
            yield AFTER[initial][state], KEEP + more, "K"
        yield NEXT[state], REROLE + more, "R"


def reverse_edges(row: tuple[str, int], state: int):
    """(state before, cost, initial) of the edits of a row that end in ``state``."""
    for before in range(4):
        for after, cost, name in edges(row, before):
            if after == state:
                yield before, cost, name


def cheapest(rows: list[tuple[str, int]], start: int = 0, ends: tuple[int, ...] = ACCEPT) -> tuple[int, str] | None:
    """Least cost and its least audit from ``start`` before the rows to one of ``ends`` behind them."""
    n = len(rows)
    labels = [{(0, start): (0, "")}, {(n, t): (0, "") for t in ends}]
    heaps = [[(0, 0, (0, start))], [(0, 0, (n, t)) for t in ends]]
    settled, best = [set(), set()], None
    if (0, start) in labels[1]:
        best = 0
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int((heaps[1][0][0], len(settled[1])) < (heaps[0][0][0], len(settled[0])))
        cost, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        audit, (i, state) = labels[side][node][1], node
        if side == 0:
            reached = [((i, NEXT[state]), INSERT, "I")]
            reached += [((i + 1, t), c, e) for t, c, e in edges(rows[i], state)] if i < n else []
        else:
            reached = [((i, s), INSERT, "I") for s in range(4) if NEXT[s] == state]
            reached += [((i - 1, s), c, e) for s, c, e in reverse_edges(rows[i - 1], state)] if i else []
        for to, more, edit in reached:
            label = (cost + more, audit + edit if side == 0 else edit + audit)
            known = labels[side].get(to)
            if known is None or label < known:
                labels[side][to] = label
                if known is None or label[0] < known[0]:
                    heapq.heappush(heaps[side], (label[0], to[0] if side == 0 else -to[0], to))
                if to in labels[1 - side]:
                    crossing = label[0] + labels[1 - side][to][0]
                    best = crossing if best is None else min(best, crossing)
    if best is None:
        return None
    forward, reverse = labels
    return best, min(a + reverse[node][1] for node, (c, a) in forward.items() if node in reverse and c + reverse[node][0] == best)


def repaired(audit: str, rows):
    """The messages ``(role, text)`` that an audit makes of ``(role, text)`` rows."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = AFTER[role[:1]][state]
            yield role, text
        elif edit == "R":
            state = NEXT[state]
            yield ROLE[state], text


def fault_of(text: str, seen: bool) -> tuple[int, int]:
    """Class for the lattice, and which of blank, duplicate, truncated it is (3: none)."""
    left = text.rstrip(SPACE)
    if not left:
        return GONE, 0
    if seen:
        return GONE, 1
    return (FINE, 3) if left[-1] in ".!?" else (CUT_OFF, 2)


class _Out:
    """Rows of ``RESULT``: a conversation's text in parts, its figures on the last."""

    def __init__(self):
        self.rows = []

    def write(self, conv_id, messages, figures):
        """Adds a conversation; yields a batch whenever a part is full."""
        digest, lines, size, part, first = hashlib.sha256(), [], 0, 0, True
        for role, text in messages:
            line = ("" if first else "\n") + role + ":" + text
            first = False
            digest.update(line.encode("utf-8", "surrogatepass"))
            lines.append(line)
            size += len(line)
            if size > PART:
                self.rows.append((conv_id, part, "".join(lines), False, None, *[None] * len(FIGURES)))
                yield self.batch()
                lines, size, part = [], 0, part + 1
        self.rows.append((conv_id, part, "".join(lines), True, digest.hexdigest(), *figures))

    def batch(self):
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 5, pa.string()]
        names = ["conv_id", "part", "repaired", "last", "repaired_sha256", *FIGURES]
        columns = list(zip(*self.rows)) or [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _whole(batches):
    """Conversations of bounded size, whose rows come in order."""
    out, now, rows = _Out(), None, []

    def finish():
        seen, kinds, counts, lattice = set(), [r[:1] for r, _ in rows], [0, 0, 0, 0], []
        for role, text in rows:
            fault, kind = fault_of(text, (role, text) in seen)
            seen.add((role, text))
            counts[kind] += 1
            lattice.append((role[:1], fault))
        illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:]))
        cost, audit = cheapest(lattice)
        yield from out.write(now, repaired(audit, rows), (*counts[:3], illegal, cost, audit))

    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if rows and conv_id != now:
                yield from finish()
                rows = []
            now = conv_id
            rows.append((role, text))
        yield out.batch()
    if rows:
        yield from finish()
        yield out.batch()


BLOCKS = ("conv_id long, task int, block int, place int, role string, text string, first string, final string, "
          "blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>")


def _blocks(size: int):
    """Rows of long conversations, with their place, and after each block its figures
    (``place`` null): the cheapest audit between any two states."""
    def run(batches):
        from pyspark import TaskContext
        task, number, now, rows, before = TaskContext.get().partitionId(), 0, None, [], None
        columns = [f.split()[0] for f in BLOCKS.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 4, *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.string())]

        def finish():
            counts, lattice = [0, 0, 0, 0], []
            for role, text, seen in rows:
                fault, kind = fault_of(text, seen)
                counts[kind] += 1
                lattice.append((role[:1], fault))
            kinds_ = [x for x, _ in lattice]
            found = [cheapest(lattice, s, (t,)) for s in range(4) for t in range(4)]
            held = [(now, task, number, i, role, text, *[None] * 8) for i, (role, text, _) in enumerate(rows)]
            held.append((now, task, number, None, None, None, kinds_[0], kinds_[-1], *counts[:3], sum(p not in LEGAL for p in zip(kinds_, kinds_[1:])),
                         [x and x[0] for x in found], [x and x[1] for x in found]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], columns)

        for batch in batches:
            for conv_id, turn, role, text, digest, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "again"))):
                if rows and (conv_id != now or len(rows) >= size):
                    yield finish()
                    rows, number = [], number + 1
                now = conv_id
                rows.append((role, text, again or (conv_id, turn, role, digest) == before))
                before = (conv_id, turn, role, digest)
        if rows:
            yield finish()
    return run


def _chain(batches):
    """One row a conversation from its blocks in order."""
    now, live, sure, counts, final, got = None, None, [], [0] * 4, None, []

    def finish():
        cost, tail = min(live[s] for s in ACCEPT if s in live)
        got.append((now, *counts, cost, "".join(sure) + tail))

    def batch_of():
        kinds = [pa.int64()] * 6 + [pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*got)) or [()] * 7, kinds)], ["conv_id", *FIGURES])
        got.clear()
        return out

    for batch in batches:
        for r in batch.to_pylist():
            if live is None or r["conv_id"] != now:
                if live is not None:
                    finish()
                now, live, sure, counts, final = r["conv_id"], {0: (0, "")}, [], [0] * 4, None
            after = {}
            for s, (cost, tail) in live.items():
                for t in range(4):
                    if r["costs"][4 * s + t] is not None:
                        label = (cost + r["costs"][4 * s + t], tail + r["audits"][4 * s + t])
                        after[t] = min(after.get(t, label), label)
            common = commonprefix([tail for _, tail in after.values()])
            sure.append(common)
            live = {t: (cost, tail[len(common):]) for t, (cost, tail) in after.items()}
            crossing = final is not None and (final, r["first"]) not in LEGAL
            counts = [a + r[k] for a, k in zip(counts, FIGURES)]
            counts[3] += crossing
            final = r["final"]
        yield batch_of()
    if live is not None:
        finish()
        yield batch_of()


def _stream(batches):
    """Repaired text of long conversations: their figures come first, then their rows."""
    def records():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", *FIGURES)))

    rest, waiting = records(), []

    def rows():
        for r in rest:
            if r[1] is None:
                waiting.append(r)
                return
            yield r[2], r[3]

    out = _Out()
    head = next(rest, None)
    while head is not None:
        mine = rows()
        yield from out.write(head[0], repaired(head[-1], mine), head[4:])
        for _ in mine:                      # rows deleted at the end
            pass
        head = waiting.pop() if waiting else None
        yield out.batch()


def repair_conversations(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``RESULT`` and ``gaps``: the repaired conversations, ``role:text`` lines in parts
    of about ``PART`` characters; digest and figures stand on the ``last`` part."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_n"))
    sizes = turns.groupBy("conv_id").agg(
        F.sum("_n").alias("_n"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    sizes = cut(sizes, "sizes").withColumnRenamed("conv_id", "_conv")
    large = sizes.where(F.col("_n") > block).select("_conv")
    n = large.count()
    large = F.broadcast(large) if n <= FEW else large

    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = ["conv_id", "turn", "role", "digest"]
    short = rows.join(large, same, "left_anti") if n else rows
    result = short.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_whole, RESULT)
    if n:
        long = rows.join(large, same, "left_semi")
        key = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
        first = (long.withColumn("_key", key).groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
                 .agg(F.min("_key").alias("_first")))
        long = (long.join(first, same & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
                .withColumn("again", key > F.col("_first")).select(*order, "text", "again"))
        placed = cut(long.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block), BLOCKS), "blocks")
        chained = (placed.where("place is null").select("conv_id", "task", "block", "first", "final", *FIGURES[:4], "costs", "audits")
                   .repartition("conv_id").sortWithinPartitions("conv_id", "task", "block")
                   .mapInArrow(_chain, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
        nothing = [F.lit(None).cast("long").alias(c) for c in FIGURES[:5]] + [F.lit(None).cast("string").alias("audit")]
        head = chained.select("conv_id", F.lit(-1).alias("task"), F.lit(0).alias("block"), F.lit(None).cast("int").alias("place"),
                              F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *FIGURES)
        lines = placed.where("place is not null").select("conv_id", "task", "block", "place", "role", "text", *nothing)
        result = result.unionByName(head.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "task", "block", "place")
                                    .mapInArrow(_stream, RESULT))
    return result.join(sizes.select("_conv", "gaps"), same).drop("_conv")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that ``crc32(conv_id:turn) % 20`` names."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = (F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(or_space("text"), "[.!?]", ""))
            .otherwise(or_space("text")))
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("_fault", fault).where("_fault <> 0")
            .withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text")))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row for every ``conv_id`` of the undamaged table."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    found = repair_conversations(damaged(conversations)).where("last").drop("part", "repaired", "last")
    figure = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return (ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("_id").alias("conv_id"), *map(figure, ("gaps", *FIGURES[:5])), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))


#: The lattice row by row, with the repaired lines carried along.
SQL = r"""
with recursive faulty as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 as fault
  from conversations),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from faulty, (values (0), (1)) copies(copy) where fault <> 0 and (copy = 0 or fault = 3)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i,
    left(role, 1) as initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
  from damaged),
judged as (
  select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else 'fine' end as kind,
    lag(initial) over (partition by conv_id order by i) as before
  from numbered),
inserts(s, t, lines, price, edits) as (
  values (0, 0, []::varchar[], 0, ''), (1, 1, []::varchar[], 0, ''), (2, 2, []::varchar[], 0, ''), (3, 3, []::varchar[], 0, ''),
    (0, 2, ['user:'], 3, 'I'), (1, 2, ['user:'], 3, 'I'), (2, 3, ['assistant:'], 3, 'I'), (3, 2, ['user:'], 3, 'I'),
    (0, 3, ['user:', 'assistant:'], 6, 'II'), (1, 3, ['user:', 'assistant:'], 6, 'II')),
edges(s, t, initial, edit, price, given) as (
  values (0, 0, null, 'D', 4, null), (1, 1, null, 'D', 4, null), (2, 2, null, 'D', 4, null), (3, 3, null, 'D', 4, null),
    (0, 1, 's', 'K', 0, null), (0, 2, 'u', 'K', 0, null), (1, 2, 'u', 'K', 0, null), (3, 2, 'u', 'K', 0, null), (2, 3, 'a', 'K', 0, null),
    (0, 2, null, 'R', 3, 'user'), (1, 2, null, 'R', 3, 'user'), (3, 2, null, 'R', 3, 'user'), (2, 3, null, 'R', 3, 'assistant')),
walk(conv_id, i, s, cost, audit, lines) as (
  select distinct conv_id, 0::bigint, 0, 0::bigint, '', []::varchar[] from judged
  union all
  select conv_id, i, s, cost, audit, lines from (
    select w.conv_id, w.i + 1 as i, e.t as s,
      w.cost + n.price + e.price + case when e.edit <> 'D' and r.kind = 'truncated' then 3 else 0 end as cost,
      w.audit || n.edits || e.edit as audit,
      w.lines || n.lines || case when e.edit = 'D' then []::varchar[] else [coalesce(e.given, r.role) || ':' || r.text] end as lines,
      row_number() over (partition by w.conv_id, e.t order by
        w.cost + n.price + e.price + case when e.edit <> 'D' and r.kind = 'truncated' then 3 else 0 end, w.audit || n.edits || e.edit) as place
    from walk w join inserts n on n.s = w.s join judged r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1
      join edges e on e.s = n.t and (e.initial is null or e.initial = r.initial) and (e.edit = 'D' or r.kind in ('fine', 'truncated'))) x
  where place = 1),
figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
    count(*) filter (kind = 'blank') as blank, count(*) filter (kind = 'duplicate') as duplicate, count(*) filter (kind = 'truncated') as truncated,
    count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id),
ended as (
  select w.conv_id, w.cost + n.price as cost, w.audit || n.edits as audit, array_to_string(w.lines || n.lines, chr(10)) as repaired
  from walk w join figures f on f.conv_id is not distinct from w.conv_id and f.n = w.i join inserts n on n.s = w.s and n.t in (0, 3)
  qualify row_number() over (partition by w.conv_id order by w.cost + n.price, w.audit || n.edits) = 1)
select o.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0)::bigint as blank, coalesce(f.duplicate, 0)::bigint as duplicate,
  coalesce(f.truncated, 0)::bigint as truncated, coalesce(f.illegal, 0)::bigint as illegal, coalesce(e.cost, 0)::bigint as cost,
  coalesce(e.audit, '') as audit, sha256(coalesce(e.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join figures f on f.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
"""
