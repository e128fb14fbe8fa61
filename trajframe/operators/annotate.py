"""Sub-goal annotation: parse, align, repair, label.

Parsing (L1/L2), labelling (L6) and the gap/repair bookkeeping (L5) are
native column/window jobs.  The alignment DP (L4) is O(n*m) per episode and
runs in ``mapInPandas`` over one row per *mismatching* episode: episodes whose
annotated sequence already equals the gold one are removed first with an
array equality, so most episodes never reach Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import py_strip
from ..session import cut
from .blocks import chunk_of, renumber, running_sum

EPISODE = ("task_no", "variation_id")
ITEM_RE = r"(?:^|\s)\d+-\s*[^{}]*?:\s*\{[^{}]*\}"


# --- L1 / L2 -------------------------------------------------------------------

def explode_annotations(answers: DataFrame, keys: Sequence[str] = EPISODE, answer: str = "answer",
                        mark: bool = False) -> DataFrame:
    """L1: ``1- name(args): {'a', 'b'} 2- ...`` -> one row per (sub-goal
    item, action): ``sg_no`` (the item number), ``sg`` (trimmed name),
    ``act_no`` (1-based within the item), ``action`` and ``idx`` (0-based
    over the whole answer).  Items are recognised by their number at a token
    boundary; actions are split on ``,`` and lose ``{ } , .`` and quotes.
    L2 (``mark=True``) appends ``end subgoal`` to every item."""
    items = F.regexp_extract_all(F.col(answer), F.lit(ITEM_RE), F.lit(0))
    a = answers.select(*keys, F.posexplode(items).alias("_ipos", "_item"))
    a = a.select(
        *keys, "_ipos",
        F.regexp_extract("_item", r"(\d+)-", 1).cast("int").alias("sg_no"),
        py_strip(F.regexp_extract("_item", r"\d+-\s*([^{}]*?)\s*:\s*\{", 1)).alias("sg"),
        F.regexp_extract("_item", r"\{([^{}]*)\}", 1).alias("_acts"),
    )
    acts = F.transform(F.split("_acts", ","), lambda x: py_strip(F.regexp_replace(x, r"[{,}.']", "")))
    acts = F.filter(acts, lambda x: x != "")
    if mark:
        acts = F.concat(acts, F.array(F.lit(fixed.MARKER_ACTION)))
    e = a.select(*keys, "_ipos", "sg_no", "sg", F.posexplode(acts).alias("_apos", "action"))
    w = Window.partitionBy(*keys).orderBy("_ipos", "_apos")
    return e.select(*keys, "sg_no", "sg", (F.col("_apos") + 1).alias("act_no"), "action",
                    (F.row_number().over(w) - 1).cast("int").alias("idx"))


def rejected_items(answers: DataFrame, keys: Sequence[str] = EPISODE, answer: str = "answer") -> DataFrame:
    """Answers that contain no parseable ``n- name: {...}`` item."""
    items = F.regexp_extract_all(F.col(answer), F.lit(ITEM_RE), F.lit(0))
    return answers.where(F.size(items) == 0).select(*keys, answer)


# --- L4 --------------------------------------------------------------------------

#: Cells of the table up to which it is the faster way, and pieces compared at a time.
CELLS, STRIDE, LEVELS = 1 << 24, 32, 32


def _script_by_table(left: np.ndarray, right: np.ndarray) -> list[tuple[str, int, int]]:
    """``edit_script`` of short sequences, with a table of two bits a cell.

    Let L(i, j) be the length of a longest common subsequence from gold i and
    annotation j on.  Walking from the start, gold i is an ``add`` when leaving it out
    keeps L, else annotation j is a ``remove`` when leaving it out keeps L, else the two
    match.  Rows of L are built from the end, one array operation a row."""
    n, m = len(left), len(right)
    below = np.zeros(m + 1, np.int32)
    free_add, free_remove = [], []
    for x in left[::-1]:
        best = below.copy()
        best[:m] = np.maximum(best[:m], np.where(right == x, below[1:] + 1, 0))
        row = np.maximum.accumulate(best[::-1])[::-1]
        free_add.append(np.packbits(row[:m] == below[:m]))
        free_remove.append(np.packbits(row[:m] == row[1:]))
        below = row
    bit = lambda rows, i, j: rows[n - 1 - i][j >> 3] >> (7 - (j & 7)) & 1
    ops, i, j = [], 0, 0
    while i < n and j < m:
        if bit(free_add, i, j):
            ops.append(("add", i, j))
            i += 1
        elif bit(free_remove, i, j):
            ops.append(("remove", i, j))
            j += 1
        else:
            i, j = i + 1, j + 1
    return ops + [("add", k, m) for k in range(i, n)] + [("remove", n, k) for k in range(j, m)]


class _Reach:
    """How far r edits reach from the ends of two sequences.  On the diagonal k = x - y
    (x and y elements taken from the ends of ``left`` and ``right``) an entry is the
    greatest x that r edits reach; a diagonal of the other parity needs r - 1."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.a, self.b = left[::-1], right[::-1]
        self.n, self.m = len(left), len(right)

    def slide(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Moves every entry along its diagonal as far as the elements are equal."""
        live = np.flatnonzero(x >= 0)
        step = np.arange(STRIDE)
        while len(live):
            at, to = x[live, None] + step, (x[live] - k[live])[:, None] + step
            within = (at < self.n) & (to < self.m)
            same = within & (self.a[np.where(within, at, 0)] == self.b[np.where(within, to, 0)]) if self.n and self.m else within
            run = np.where(same.all(1), STRIDE, same.argmin(1))
            x[live] += run
            live = live[run == STRIDE]
        return x

    def first(self) -> tuple[int, np.ndarray]:
        return 0, self.slide(np.zeros(1, np.int64), np.zeros(1, np.int64))

    def next(self, level: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        r, reach = level[0] + 1, level[1]
        k = np.arange(-r, r + 1, 2)
        x = np.full(r + 1, -1)
        x[1:] = np.where((reach >= 0) & (reach < self.n), reach + 1, -1)
        other = np.where((reach >= 0) & (reach - k[:-1] <= self.m), reach, -1)
        x[:-1] = np.maximum(x[:-1], other)
        return r, self.slide(x, k)

    def whole(self, level: tuple[int, np.ndarray]) -> bool:
        r, reach = level
        k = self.n - self.m
        return abs(k) <= r and (k + r) % 2 == 0 and reach[(k + r) // 2] >= self.n

    def falling(self, level: tuple[int, np.ndarray], end: int):
        """The levels below ``end`` down to ``level``, the highest first.  Of each stretch
        the middle is kept and the halves are found again, the upper one first."""
        if end - level[0] <= LEVELS:
            held = [level]
            while held[-1][0] + 1 < end:
                held.append(self.next(held[-1]))
            yield from reversed(held)
            return
        middle = level
        while middle[0] < (level[0] + end) // 2:
            middle = self.next(middle)
        yield from self.falling(middle, end)
        yield from self.falling(level, middle[0])


def _script_in_line(left: np.ndarray, right: np.ndarray) -> list[tuple[str, int, int]]:
    """``edit_script`` of long sequences in space that grows with their lengths.

    The number of edits is searched greedily, level by level (``_Reach``); the trace
    needs the levels from the last to the first, which are found again by halving the
    levels, so that only as many as there are halvings are held.  A point lies
    within r edits of the end exactly when level r reaches it, which is all that the
    rule of the table asks."""
    reach = _Reach(left, right)
    level = start = reach.first()
    while not reach.whole(level):
        level = reach.next(level)
    n, m = reach.n, reach.m
    ops, x, y = [], n, m
    for r, far in reach.falling(start, level[0]) if level[0] else ():
        # r + 1 edits are left: matches until an edit leads to a point that r edits reach
        while True:
            k = x - y
            if x and -r <= k - 1 <= r and far[(k - 1 + r) // 2] >= x - 1:
                ops.append(("add", n - x, m - y))
                x -= 1
                break
            if y and -r <= k + 1 <= r and far[(k + 1 + r) // 2] >= x:
                ops.append(("remove", n - x, m - y))
                y -= 1
                break
            x, y = x - 1, y - 1
    return ops


def edit_script(gold: list, ann: list) -> tuple[int, list[tuple[str, int, int]]]:
    """Shortest script of insertions and deletions that turns ``ann`` into ``gold``,
    the last elements counting as equal: ``(distance, [(op, i, j)])``.  Of several, an
    ``add`` comes as early as one can, then a ``remove``.  The common end
    is never edited, so it is cut off; what is left goes through the table or, where
    that would be large, through the search in linear space."""
    if not len(gold) or not len(ann):
        return max(len(gold), len(ann)), []
    names: dict = {}
    left, right = (np.array([names.setdefault(x, len(names)) for x in seq[:-1]], np.int64) for seq in (gold, ann))
    shared = min(len(left), len(right))
    differ = np.flatnonzero(left[len(left) - shared:][::-1] != right[len(right) - shared:][::-1])
    same = int(differ[0]) if len(differ) else shared
    left, right = left[:len(left) - same], right[:len(right) - same]
    ops = (_script_by_table if len(left) * len(right) <= CELLS else _script_in_line)(left, right)
    return len(ops), ops


def _align_batches(keys: list[str]):
    def run(batches):
        for pdf in batches:
            out = []
            for *key, gold, ann in pdf[[*keys, "gold", "ann"]].itertuples(index=False):
                distance, ops = edit_script(list(gold), list(ann))
                out += [(*key, distance, *op) for op in ops or [(None, None, None)]]
            yield pd.DataFrame(out, columns=[*keys, "distance", "op", "i", "j"])
    return run


def sequences(steps: DataFrame, keys: Sequence[str], order: str, col: str, name: str) -> DataFrame:
    """One ordered array per episode."""
    return steps.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v")))),
                    lambda x: x["v"]).alias(name))


def align(gold: DataFrame, ann: DataFrame, keys: Sequence[str] = EPISODE, order: str = "step",
          col: str = "action") -> DataFrame:
    """L4: edit rows ``(op, i, j)`` and ``distance`` per episode.  Episodes
    whose sequences are equal (or whose last elements alone differ) get one
    row with distance 0 and null op without entering Python."""
    # both sequences from one grouping of the tagged union (one shuffle)
    tag = gold.select(*keys, F.col(order).alias("_o"), F.col(col).alias("_v"), F.lit(0).alias("_side")).unionByName(
        ann.select(*keys, F.col(order).alias("_o"), F.col(col).alias("_v"), F.lit(1).alias("_side")))

    def seq(side):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.struct("_o", "_v")))),
                           lambda x: x["_v"])

    both = tag.groupBy(*keys).agg(seq(0).alias("gold"), seq(1).alias("ann"))
    both = both.where((F.size("gold") > 0) & (F.size("ann") > 0))
    same = F.slice("gold", 1, F.size("gold") - 1) == F.slice("ann", 1, F.size("ann") - 1)
    eq = both.where(same & (F.size("gold") == F.size("ann")))
    rest = both.where(~(same & (F.size("gold") == F.size("ann"))))
    key_fields = [f for f in both.schema.fields if f.name in keys]
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    schema = StructType(key_fields + [StructField("distance", IntegerType()), StructField("op", StringType()),
                                      StructField("i", IntegerType()), StructField("j", IntegerType())])
    done = rest.mapInPandas(_align_batches(list(keys)), schema)
    zero = eq.select(*keys, F.lit(0).alias("distance"), F.lit(None).cast("string").alias("op"),
                     F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"))
    return zero.unionByName(done)


# --- L5 ------------------------------------------------------------------------------

def fill_gaps(repaired: DataFrame, gap_answers: DataFrame, keys: Sequence[str] = EPISODE, order: str = "step") -> DataFrame:
    """Steps of gaps take the sub-goals of ``gap_answers`` (keys, gap_start, idx,
    action, sg), matched by position and action; the others stay null."""
    ga = gap_answers.groupBy(*keys, "gap_start", (F.col("gap_start") + F.col("idx")).cast("long").alias(order), "action").agg(F.min("sg").alias("_gsg"))
    j = repaired.withColumn(order, F.col(order).cast("long")).join(ga.hint("merge"), [*keys, "gap_start", order, "action"], "left")
    return j.withColumn("subgoal", F.when(F.col("source") == "gap", F.col("_gsg")).otherwise(F.col("subgoal"))).select(*repaired.columns)


def repair(edits: DataFrame, gold: DataFrame, ann: DataFrame, keys: Sequence[str] = EPISODE,
           order: str = "step", gap_answers: DataFrame | None = None) -> DataFrame:
    """The repaired annotation, one row per gold step.

    Removed annotated rows are dropped; matched rows keep their sub-goal; an
    added gold step that is alone inherits the sub-goal of the annotated row
    before it (its own neighbour's when first); runs of >= 2 added steps are
    gaps, and so is a whole episode without annotation: they take the sub-goals
    of ``gap_answers`` (``fill_gaps``), or stay null with source ``gap``.  Gold and the
    repaired annotation are then equal by construction, so no further round
    changes anything.  Positions are counted in chunks where ``gold`` tells long
    episodes (``_nb``), and runs of added steps are an aggregate, so no episode is one
    task's work."""
    keys = list(keys)
    known = ["_nb"] if "_nb" in gold.columns else []
    g = gold.select(*keys, F.col(order).cast("long").alias("i"), F.col("action"), *known)
    added = edits.where(F.col("op") == "add").select(*keys, F.col("i").cast("long").alias("i"), F.col("j").alias("_aj"))
    there = ann.select(*keys).distinct().withColumn("_there", F.lit(True))
    # rows of steps in small files are merged, not broadcast
    gi = (g.join(added.hint("merge"), [*keys, "i"], "left").join(there.hint("merge"), keys, "left")
          .withColumn("_bare", F.col("_there").isNull()).withColumn("_added", F.col("_aj").isNotNull() | F.col("_bare"))
          .withColumn("_match", (~F.col("_added")).cast("long")))
    a = ann.select(*keys, F.col(order).alias("_j"), F.col("subgoal").alias("_sg"))
    # matched gold positions pair, in order, with the annotated rows that are not removed
    removed = edits.where(F.col("op") == "remove").select(*keys, F.col("j").alias("_j"))
    kept = a.join(removed.hint("merge"), [*keys, "_j"], "left_anti")
    kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_j")).cast("long")).drop("_j")
    gi = running_sum(gi.withColumn("_chunk", chunk_of(gi, "i")), keys, "i", "_match", "_k").drop("_chunk")
    gi = gi.withColumn("_k", F.when(~F.col("_added"), F.col("_k")))
    # an added step is inserted before annotated row j: it takes row j-1's sub-goal (row j's when j = 0)
    gi = gi.withColumn("_src_j", F.when(F.col("_aj") > 0, F.col("_aj") - 1).otherwise(F.col("_aj")))
    # runs of consecutive added positions (gaps-and-islands)
    new = renumber(gi.where("_added").select(*keys, "i", *known), keys, "i", "_n").withColumn("_isl", F.col("i") - F.col("_n"))
    runs = new.groupBy(*keys, "_isl").agg(F.count(F.lit(1)).alias("_run"), F.min("i").alias("gap_start"))
    gi = gi.join(new.select(*keys, "i", "_isl").join(runs.hint("merge"), [*keys, "_isl"]).drop("_isl").hint("merge"), [*keys, "i"], "left")
    j = (gi.join(kept.hint("merge"), [*keys, "_k"], "left")
         .join(a.select(*keys, F.col("_j").alias("_src_j"), F.col("_sg").alias("_inh")).hint("merge"), [*keys, "_src_j"], "left"))
    alone = (F.col("_run") == 1) & ~F.col("_bare")
    src = F.when(~F.col("_added"), F.lit("matched")).when(alone, F.lit("inherited")).otherwise(F.lit("gap"))
    sg = F.when(~F.col("_added"), F.col("_sg")).when(alone, F.col("_inh"))
    out = j.withColumn("source", src).withColumn("subgoal", sg).select(
        *keys, F.col("i").alias(order), "action", "subgoal", "source", F.when(F.col("source") == "gap", F.col("gap_start")).alias("gap_start"))
    return out if gap_answers is None else fill_gaps(out, gap_answers, keys, order)


def gap_requests(repaired: DataFrame, keys: Sequence[str] = EPISODE, order: str = "step") -> DataFrame:
    """Runs of >= 2 unannotated gold steps as request rows (C12 input)."""
    gaps = repaired.where(F.col("source") == "gap")
    return gaps.groupBy(*keys, "gap_start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "action"))), lambda x: x["action"]).alias("missed"))


# --- L6 ---------------------------------------------------------------------------------

def label_steps(steps: DataFrame, ann: DataFrame, keys: Sequence[str] = EPISODE, order: str = "step",
                ann_order: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Attach the annotated sub-goal to each step by position; returns
    (labelled steps, violations).  Violations list positions whose actions
    differ and episodes whose lengths differ."""
    a = ann.select(*keys, F.col(ann_order).alias(order), F.col("action").alias("_ann_action"),
                   F.col("sg").alias("subgoal"))
    s = steps.drop("subgoal") if "subgoal" in steps.columns else steps
    lab = s.join(a, [*keys, order], "left")
    bad = lab.where(F.col("_ann_action").isNull() | (F.col("_ann_action") != F.col("action"))) \
        .select(*keys, order, "action", "_ann_action")
    return lab.drop("_ann_action"), bad


# --- C11 / C12 ------------------------------------------------------------------------------

SYSTEM_TEXT = "You are a helpful assistant."


def path_text(actions: Column) -> Column:
    """Paths join as ``a, b, `` (with the trailing comma)."""
    return F.array_join(F.transform(actions, lambda x: F.concat(x, F.lit(", "))), "")


def annotation_prompt(eps: DataFrame, exemplar: DataFrame, keys: Sequence[str] = EPISODE,
                      task: str = "task_no", task_desc: str = "task_desc", path: str = "path",
                      description: str = "", opening: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """C11: one message array per episode: system text with the ``description`` of
    the format, the ``opening`` messages that are the same for all tasks (a worked
    example; data of a message file, S5), the task's exemplar (T8) as a user/assistant
    pair, then the new path."""
    ex = exemplar.select(task, F.col("path").alias("_ex_path"), F.col("answer").alias("_ex_answer"))
    j = eps.join(F.broadcast(ex), task, "left")      # one exemplar for each of the 30 tasks
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT + description).alias("content")),
        *(F.struct(F.lit(role).alias("role"), F.lit(content).alias("content")) for role, content in opening),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.col(task_desc), F.lit("Here is the goal path to achieve to the goal:"),
                          F.coalesce(F.col("_ex_path"), F.lit(""))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.coalesce(F.col("_ex_answer"), F.lit("")).alias("content")),
        F.struct(F.lit("user").alias("role"),
                 F.concat(F.col(task_desc), F.lit("Here is the goal path to achieve to the goal:"),
                          F.col(path)).alias("content")),
    )
    return j.select(*keys, msgs.alias("messages"))


def gap_prompt(gaps: DataFrame, eps: DataFrame, keys: Sequence[str] = EPISODE,
               task_desc: str = "task_desc", path: str = "path", answer: str = "answer", description: str = "") -> DataFrame:
    """Request for a run of unannotated steps: the whole path and the
    earlier answer as context, then the missed actions."""
    j = gaps.join(eps.select(*keys, task_desc, path, answer), list(keys), "inner")
    missed = F.concat(F.lit("["), F.array_join(F.transform("missed", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_TEXT + description).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(
            F.col(task_desc), F.lit("Here is the goal path to achieve to the goal:"), F.col(path),
            F.lit(". Based on the given goal path, you already provided me with the functional format of high-level "
                  "sub-tasks to complete this task and their correspondings actions.which are: "),
            F.col(answer)).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(
            F.lit(". Now, here is the goal path"), missed,
            F.lit(" What is the functional format of high-level sub-task assigned to these actions? "
                  "Tell them in numeric format.")).alias("content")),
    )
    return j.select(*keys, "gap_start", msgs.alias("messages"))


# --- L7 --------------------------------------------------------------------------------------

def annotate(eps_steps: DataFrame, cache: DataFrame, answer_fn: Callable[[DataFrame], DataFrame],
             gap_fn: Callable[[DataFrame], DataFrame] | None = None, keys: Sequence[str] = EPISODE,
             order: str = "step") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take cached answers, ask ``answer_fn`` for the missing episodes (a
    DataFrame -> DataFrame hook: keys -> keys, answer; a table join in tests,
    ``mapInPandas`` around a client in production), explode, align, repair, ask
    ``gap_fn`` for the gaps (keys, gap_start, missed -> keys, gap_start, answer), splice
    its answers, label and insert the segment markers.  One answer an episode
    counts: the cached one, else the least.  Returns ``(labelled steps with
    markers, answers to append to the cache, report)``; the report lists every step
    left without sub-goal, and why."""
    from .joins import annotation_requests
    from .windows import insert_markers
    keys = list(keys)
    # what several jobs read is written once; the hooks are asked once
    eps_steps = cut(eps_steps, "steps")
    usable = F.col("answer").isNotNull() & (F.length("answer") > 0)
    have = cut(cache.where(usable).groupBy(*keys).agg(F.min("answer").alias("answer")), "cached")
    need = annotation_requests(eps_steps.select(*keys).distinct(), have, keys)
    fresh = cut(answer_fn(need).where(usable).groupBy(*keys).agg(F.min("answer").alias("answer")).join(have.select(*keys), keys, "left_anti"), "fresh")
    ann = explode_annotations(have.unionByName(fresh), keys)
    ann_steps = cut(ann.select(*keys, F.col("idx").cast("long").alias(order), "action", F.col("sg").alias("subgoal")), "annotation")
    edits = cut(align(eps_steps, ann_steps, keys, order), "edits")
    rows = cut(repair(edits, eps_steps, ann_steps, keys, order), "repaired")
    if gap_fn is not None:
        asked = cut(gap_fn(gap_requests(rows, keys, order)).where(usable).groupBy(*keys, "gap_start").agg(F.min("answer").alias("answer")), "gaps")
        rows = fill_gaps(rows, explode_annotations(asked, [*keys, "gap_start"]), keys, order)
    labelled = cut(eps_steps.drop("subgoal").join(rows.select(*keys, order, "subgoal", "source").hint("merge"), [*keys, order], "left"), "labelled")
    why = F.when(F.col("source") == "gap", "gap without a fitting answer").otherwise("annotated row without sub-goal")
    report = labelled.where("subgoal is null").select(*keys, order, "action", why.alias("why"))
    return insert_markers(labelled, keys), fresh, report


# --- L3 ---------------------------------------------------------------------------------------

def _walk(keys: list[str]):
    """Per-partition walk over rows sorted by episode: what was offered comes first (it is
    one answer) and is held, the gold steps stream by it."""
    def run(batches):
        cur, offered, at = None, [], 0
        for pdf in batches:
            hits = []
            kv = list(zip(*[pdf[k].tolist() for k in keys]))
            for key, side, order, action in zip(kv, pdf["_side"].tolist(), pdf["_o"].tolist(), pdf["_v"].tolist()):
                if key != cur:
                    cur, offered, at = key, [], 0
                if side == 0:
                    offered.append((order, "" if action is None else action))
                    continue
                while at < len(offered) and offered[at][1].strip() != action:
                    at += 1
                if at < len(offered):
                    hits.append((*key, order, offered[at][0]))
                    at += 1
            yield pd.DataFrame(hits, columns=[*keys, "gold_step", "idx"])
    return run


def greedy_align(gold: DataFrame, items: DataFrame, keys: Sequence[str] = EPISODE, order: str = "step",
                 col: str = "action") -> DataFrame:
    """L3: walk the annotated actions in order and accept each that equals the
    next unmatched gold action; every item that accepted an action is closed by
    an ``end subgoal`` row.  ``items`` is the L1 output (one row per action).  Adds
    the cleaned ``answer`` of the episode.  Only the walk is Python, and it streams
    the gold steps past the offered ones; the rows, their numbers and the answer
    follow from the accepted places by columns.  What is joined grows with the steps but
    may lie in small files, by whose size Spark would broadcast it: the joins are merged."""
    keys = list(keys)
    both = items.select(*keys, F.lit(0).alias("_side"), F.col("idx").cast("long").alias("_o"), F.col("action").alias("_v")).unionByName(
        gold.join(items.select(*keys).distinct().hint("merge"), keys, "left_semi").select(*keys, F.lit(1).alias("_side"), F.col(order).cast("long").alias("_o"), F.col(col).alias("_v")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys).schema.fields)
    at = (both.repartition(*keys).sortWithinPartitions(*keys, "_side", "_o")
          .mapInPandas(_walk(keys), f"{kinds}, gold_step long, idx long"))
    hits = at.join(items.select(*keys, F.col("idx").cast("long").alias("idx"), "sg_no", "sg", F.col("action").alias("_raw")).hint("merge"), [*keys, "idx"])
    # an item is the run of its actions; the item number may come again later
    parts = items.groupBy(*keys, "sg_no", "sg").agg(F.min("idx").alias("_first"))
    hits = hits.join(parts.hint("merge"), [*keys, "sg_no", "sg"])
    closed = Window.partitionBy(*keys).orderBy("_first", "sg_no", "sg")
    named = (hits.groupBy(*keys, "sg_no", "sg", "_first").agg(
        F.max("gold_step").alias("_last"), F.transform(F.array_sort(F.collect_list(F.struct("gold_step", "_raw"))), lambda x: x["_raw"]).alias("_acts"))
        .withColumn("_nth", F.row_number().over(closed)))
    piece = F.concat(F.col("_nth").cast("string"), F.lit("- "), F.col("sg"), F.lit(": {"),
                     F.array_join(F.transform("_acts", lambda x: F.concat(x, F.lit(", "))), ""), F.lit("}\n"))
    answers = named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", piece.alias("t")))), lambda x: x["t"]), "").alias("answer"))
    steps = hits.join(named.select(*keys, "sg_no", "sg", "_nth").hint("merge"), [*keys, "sg_no", "sg"]).select(
        *keys, (F.col("gold_step") + F.col("_nth") - 1).cast("int").alias("pos"), "gold_step", F.trim("_raw").alias("action"), F.col("sg").alias("subgoal"), F.lit(False).alias("is_marker"))
    marks = named.select(*keys, (F.col("_last") + F.col("_nth")).cast("int").alias("pos"), F.col("_last").alias("gold_step"),
                         F.lit(fixed.MARKER_ACTION).alias("action"), F.col("sg").alias("subgoal"), F.lit(True).alias("is_marker"))
    return steps.unionByName(marks).join(answers.hint("merge"), list(keys))
