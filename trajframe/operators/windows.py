"""Per-episode window operators.

Partition = episode, order = step.  Every window here uses the same
``partitionBy(*episode).orderBy(step)`` spec, so within one ``select``
Catalyst sorts once and evaluates all frames in one pass.  Frames are
bounded (``k preceding``) wherever the consumer only needs ``k`` items.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.actions import formalize
from ..functions.text import look_room, observation_room
from ..session import cut
from .blocks import BLOCK, all_short, carried, chunk_of, chunked, depth_blocks, renumber, running_sum

EPISODE = ("task_no", "variation_id")


def w_ep(episode: Sequence[str] = EPISODE, order: str = "step") -> Window:
    return Window.partitionBy(*episode).orderBy(order)


def trunc100(c: Column) -> Column:
    """``int(x * 100)``: truncation toward zero (python ``int``)."""
    return (c * F.lit(100)).cast("long")


# --- F1 / F2 / F6 ------------------------------------------------------------

def not_noise(action: str = "action") -> Column:
    """F1 rule: neither ``look around`` nor ``close door*``."""
    a = F.col(action)
    return ~((a == fixed.NOISE_ACTION) | a.startswith(fixed.NOISE_PREFIX))


def drop_noise_steps(steps: DataFrame, episode: Sequence[str] = EPISODE, order: str = "pos") -> DataFrame:
    """drop ``look around`` and ``close door*`` steps, then renumber ``step`` =
    0.. within the episode (``order``: a dense position), in chunks."""
    return renumber(steps.where(not_noise()), list(episode), order, "step")


def min_steps(steps: DataFrame, n: int = 2, episode: Sequence[str] = EPISODE) -> DataFrame:
    """drop episodes with fewer than ``n`` steps."""
    enough = steps.groupBy(*episode).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).drop("_n")
    return steps.join(enough, list(episode), "left_semi")


def step_io(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """one row per step i >= 1: label from step i, observation from step
    i-1, look / inventory from step i."""
    w = w_ep(episode)
    return (steps.withColumn("prev_observation", F.lag("observation").over(w))
            .withColumn("prev_action", F.lag("action").over(w))
            .where(F.col("step") >= 1))


# --- W1 / W2 / W3 / W6: sentinel-shifted history ----------------------------

def with_history_state(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """W1/W2/W6 building blocks.

    Row 0 is replaced by the sentinel (``look around``, ``N/A``, score 0) in
    the *history* columns ``h_action/h_obs/h_score``; ``reward`` is the score
    delta against that shifted series, ``prev_score`` the score shown at row
    i (sentinel 0 at row 1) and ``returns_to_go`` = round(1 - prev raw score, 2).
    """
    w = w_ep(episode)
    first = F.col("step") == 0
    df = steps.select(
        "*",
        F.when(first, F.lit(fixed.SENTINEL_ACTION)).otherwise(F.col("action")).alias("h_action"),
        F.when(first, F.lit(fixed.SENTINEL_OBSERVATION)).otherwise(F.col("observation")).alias("h_obs"),
        F.when(first, F.lit(0.0)).otherwise(F.col("score").cast("double")).alias("h_score"),
    )
    return df.select(
        "*",
        F.coalesce(F.col("h_score") - F.lag("h_score").over(w), F.lit(0.0)).alias("reward"),
        F.lag("h_score").over(w).alias("prev_score"),
        F.round(F.lit(1.0) - F.lag(F.col("score").cast("double")).over(w), 2).alias("returns_to_go"),
    )


def history_item(formal: bool = True) -> Column:
    """One history item without its tag: ``> ACTION (+R) --> OBS | ``.
    Needs the columns of ``with_history_state``; evaluate it in a projection
    *before* the window so each row's item is built once."""
    act = F.coalesce(formalize("h_action"), F.lit("None")) if formal else F.coalesce(F.col("h_action"), F.lit("None"))
    return F.concat(F.lit("> "), act, F.lit(" (+"), trunc100(F.col("reward")).cast("string"), F.lit(") --> "),
                    F.coalesce(F.col("h_obs"), F.lit("None")), F.lit(" | "))


def history_from_items(item_col: str, k: int = 10, episode: Sequence[str] = EPISODE) -> Column:
    """The last ``k`` items before the current row, oldest first, tagged
    10, 9, 8 ...  Gathered with ``k`` offset (``lag``) lookups, which are O(1)
    per row, instead of re-aggregating a sliding frame."""
    w = w_ep(episode)
    lags = F.array(*[F.lag(item_col, j).over(w) for j in range(k, 0, -1)])  # oldest first
    shown = F.filter(lags, lambda x: x.isNotNull())
    return F.array_join(F.transform(shown, lambda x, i: F.concat(F.lit(" <extra_id_"), (F.lit(10) - i).cast("string"), x)), "")


def add_history(df: DataFrame, k: int = 10, formal: bool = True, episode: Sequence[str] = EPISODE,
                name: str = "history") -> DataFrame:
    """W3 on a frame that has the ``with_history_state`` columns."""
    return (df.withColumn("_hitem", history_item(formal))
            .withColumn(name, history_from_items("_hitem", k, episode)).drop("_hitem"))


def last_k(steps: DataFrame, k: int = 10, formal: bool = True, episode: Sequence[str] = EPISODE) -> DataFrame:
    """W3 as an operator: adds ``history`` (text of the last k items)."""
    return add_history(with_history_state(steps, episode), k, formal, episode)


# --- W4 / W5: sub-goals ------------------------------------------------------

def with_next_subgoal(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """Next step's sub-goal, ``complete_task()`` past the end."""
    return steps.withColumn("next_subgoal", F.lead("subgoal", 1, fixed.FINAL_SUBGOAL).over(w_ep(episode)))


def segment_start(episode: Sequence[str], col: str = "subgoal") -> Column:
    """The sub-goal where it differs from the previous row's, else null."""
    prev = F.lag(col).over(w_ep(episode))
    return F.when(prev.isNull() | (prev != F.col(col)), F.col(col))


def own_rows(df: DataFrame, value: Column) -> Column:
    """``value`` on rows of the chunk itself, null on its context rows."""
    return F.when(~F.col("_halo"), value) if "_halo" in df.columns else value


def with_subgoal_runs(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """Running list of adjacent-distinct sub-goals up to the current row; one
    entry per segment started so far.  Needs the row before as context."""
    df = steps.withColumn("_sg_start", segment_start(episode))
    df = df.withColumn("_sg_start", own_rows(df, F.col("_sg_start")))
    return df.withColumn("subgoals", F.collect_list("_sg_start").over(w_ep(episode).rowsBetween(Window.unboundedPreceding, 0))).drop("_sg_start")


def subgoal_runs(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """W5 for episodes of every size."""
    df = chunked(steps, list(episode), "step", 1, 0, with_subgoal_runs, keep=True)
    return carried(df, list(episode), "step", "subgoals").drop("_chunk")


# --- W7: visited rooms -------------------------------------------------------

def with_rooms(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """Ordered distinct rooms visited so far (rows 1..i).

    Row j >= 1 contributes the room of the observation of step j-1 and then
    the room of the look of step j.  Only the *first* occurrence of a room
    is carried in the running frame, so the running list is bounded by the
    number of distinct rooms, not by the episode length.  Needs the row before
    as context."""
    w = w_ep(episode)
    none = F.array().cast("array<string>")
    items = F.when(F.col("step") >= 1, F.filter(F.array(observation_room(F.lag("observation").over(w)), look_room("freelook")), lambda x: x.isNotNull())).otherwise(none)
    df = steps.withColumn("_rooms", items)
    df = df.withColumn("_rooms", F.coalesce(own_rows(df, F.col("_rooms")), none))
    # rooms seen strictly before this row: a running *set* (buffer bounded by
    # the distinct room pairs, not by the episode length)
    seen = F.flatten(F.collect_set("_rooms").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_new", F.array_except(F.col("_rooms"), F.coalesce(seen, none)))
    # collect_list skips nulls: only rows that add a room enter the buffer
    firsts = F.when(F.size("_new") > 0, F.col("_new"))
    return df.withColumn(
        "places", F.flatten(F.collect_list(firsts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ).drop("_rooms", "_new")


def visited_rooms(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """W7 for episodes of every size."""
    df = chunked(steps, list(episode), "step", 1, 0, with_rooms, keep=True)
    return carried(df, list(episode), "step", "places").drop("_chunk").withColumn("places", F.array_distinct("places"))


# --- W8: bounded FIFO of seen objects ------------------------------------------

def _take(objs: list, things, limit: int) -> None:
    """One step of the FIFO."""
    for t in things:
        if t not in objs:
            objs.append(t)
    del objs[:max(0, len(objs) - limit)]


def _fifo_fold(keys: list[str], limit: int, start_step: int):
    """Per-partition fold over rows sorted by (episode, chunk, step), each chunk from
    the list in ``_in``.  State is one bounded list; batches stream through."""
    def run(batches):
        cur, objs = None, []
        for pdf in batches:
            out = []
            kv = list(zip(*[pdf[k].tolist() for k in keys]))
            for key, step, things, before in zip(kv, pdf["step"].tolist(), pdf["_things"].tolist(), pdf["_in"].tolist()):
                if key != cur:
                    cur, objs = key, [] if before is None else list(before)
                if step >= start_step and things is not None:
                    _take(objs, things, limit)
                out.append(list(objs))
            pdf = pdf.drop(columns=["_things", "_rn", "_in", "_chunk"])
            pdf["objects"] = out
            yield pdf
    return run


def _chunk_ends(keys: list[str], limit: int, start_step: int):
    """The list at the end of every chunk of rows sorted as for ``_fifo_fold``."""
    def run(batches):
        cur, objs, used = None, [], []
        done = []
        for pdf in batches:
            kv = list(zip(*[pdf[k].tolist() for k in keys]))
            for key, step, things, before in zip(kv, pdf["step"].tolist(), pdf["_things"].tolist(), pdf["_in"].tolist()):
                if key != cur:
                    if cur is not None:
                        done.append((*cur, used, list(objs)))
                    cur, used = key, [] if before is None else list(before)
                    objs = list(used)
                if step >= start_step and things is not None:
                    _take(objs, things, limit)
            yield pd.DataFrame(done, columns=[*keys, "_used", "_out"])
            done = []
        if cur is not None:
            yield pd.DataFrame([(*cur, used, list(objs))], columns=[*keys, "_used", "_out"])
    return run


def _entering(rows: DataFrame, keys: list[str], limit: int, start_step: int) -> DataFrame:
    """``_in``: the list that every chunk of long episodes begins with.

    All chunks are folded at once from an empty list; those that a different list
    enters (the end of the chunk before) are folded again from it, until none is
    left.  A chunk soon forgets what it began with, so there are few rounds; a
    chunk is final one round after the one before it, so there is an end.  The
    tables of chunks have at most ``2 * blocks.SHARE`` rows."""
    by = [*keys, "_chunk"]
    rows = cut(rows.select(*by, "step", "_things").repartition(*by), "objects")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    schema = f"{kinds}, _used array<string>, _out array<string>"
    none = F.array().cast("array<string>")

    def folded(entering: DataFrame) -> DataFrame:
        one = rows.join(F.broadcast(entering), by).repartition(*by).sortWithinPartitions(*by, "step")
        return one.mapInPandas(_chunk_ends(by, limit, start_step), schema)

    before = Window.partitionBy(*keys).orderBy("_chunk")
    ends = cut(folded(rows.select(*by).distinct().withColumn("_in", none)), "chunk-ends")
    while True:
        now = ends.withColumn("_in", F.coalesce(F.lag("_out").over(before), none))
        wrong = now.where(F.col("_in") != F.col("_used")).select(*by, "_in")
        if wrong.isEmpty():
            return now.select(*by, "_in")
        again = cut(folded(wrong), "chunk-ends")
        ends = cut(ends.join(again.select(*by), by, "left_anti").unionByName(again), "chunk-ends")


def with_objects(steps: DataFrame, limit: int = fixed.OBJECT_LIMIT_OFFLINE, episode: Sequence[str] = EPISODE,
                 look: str = "freelook", start_step: int = 1) -> DataFrame:
    """Per-row state of the bounded FIFO of distinct objects.

    Each row (from ``start_step``) appends the objects of its look that are
    not in the list, then the oldest are evicted down to ``limit``; evicted
    objects may re-enter later, so this is *not* "last k distinct".  Rows are
    hash-partitioned by episode and chunk, sorted by step and folded in one
    streaming pass (``mapInPandas``, Arrow batches, O(limit) state).  An episode up
    to a block's length is one chunk; the chunks of longer ones (``_nb``) are
    folded in parallel from the lists that ``_entering`` finds."""
    from ..functions.text import object_mentions
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType
    keys = list(episode)
    known = "_nb" in steps.columns and not all_short(steps)
    df = steps.withColumn("_things", object_mentions(look)).withColumn("_chunk", chunk_of(steps, "step") if known else F.lit(0).cast("long"))
    if known and not steps.where(F.col("_nb").isNotNull()).isEmpty():
        entering = _entering(df.where(F.col("_nb").isNotNull()), keys, limit, start_step)
        df = df.join(F.broadcast(entering), [*keys, "_chunk"], "left")
    else:
        df = df.withColumn("_in", F.lit(None).cast("array<string>"))
    # a window over episode and chunk asks for the clustering and the order; Spark
    # adds a shuffle only if the input is not already partitioned by the episode (an
    # explicit repartition always would)
    # (``_rn`` is consumed by the fold, so the window is not pruned away)
    df = df.withColumn("_rn", F.row_number().over(w_ep([*keys, "_chunk"])))
    schema = StructType([f for f in df.schema.fields if f.name not in ("_things", "_rn", "_in", "_chunk")]
                        + [StructField("objects", ArrayType(StringType()))])
    if all_short(steps):                 # a column without type does not pass through Python
        schema = StructType([f for f in schema.fields if f.name != "_nb"])
        return df.drop("_nb").mapInPandas(_fifo_fold([*keys, "_chunk"], limit, start_step), schema).withColumn("_nb", F.lit(None))
    return df.mapInPandas(_fifo_fold([*keys, "_chunk"], limit, start_step), schema)


def final_objects(steps: DataFrame, limit: int, episode: Sequence[str] = EPISODE, look: str = "freelook",
                  start_step: int = 1) -> DataFrame:
    """W8 final state per episode: the state of the last step of the
    streaming fold, taken with ``max_by`` (a partial aggregate; no episode
    is collected into one row)."""
    s = with_objects(steps, limit, episode, look, start_step)
    return s.groupBy(*episode).agg(F.max_by("objects", "step").alias("objects"))


# --- W9 - W12: stop rules ---------------------------------------------------------

def loop_flag(k: int = fixed.LOOP_WINDOW, col: Column | str = "action", episode: Sequence[str] = EPISODE,
              seed: str = fixed.SENTINEL_ACTION) -> Column:
    """W9 condition at step t: at least k actions exist (the seed action
    counts) and the last k hold exactly two distinct values."""
    c = F.col(col) if isinstance(col, str) else col
    w = w_ep(episode).rowsBetween(-(k - 1), 0)
    last = F.collect_list(c).over(w)
    with_seed = F.when(F.col("step") == k - 2, F.concat(F.array(F.lit(seed)), last)).otherwise(last)
    return (F.col("step") + 2 >= k) & (F.size(F.array_distinct(with_seed)) == 2)


def stall_flag(k: int = fixed.STALL_WINDOW, col: str = "score", episode: Sequence[str] = EPISODE) -> Column:
    """W10 condition at step t: more than k scores (seed 0 counts) and the
    last k are one value."""
    w = w_ep(episode).rowsBetween(-(k - 1), 0)
    return (F.col("step") + 2 > k) & (F.min(col).over(w) == F.max(col).over(w))


def stop_step(steps: DataFrame, flag: Callable[[Sequence[str]], Column], reach: int, episode: Sequence[str] = EPISODE) -> DataFrame:
    """Per episode the first step where the rule ``flag(keys)`` fires
    (``stop_step``, null if never) and the rows kept up to it (``kept``)."""
    f = chunked(steps, list(episode), "step", reach, 0, lambda d, k: d.withColumn("_f", flag(k)))
    g = f.groupBy(*episode).agg(F.min(F.when(F.col("_f"), F.col("step"))).alias("stop_step"), F.count(F.lit(1)).alias("_n"))
    return g.select(*episode, "stop_step", F.coalesce(F.col("stop_step") + 1, F.col("_n")).cast("long").alias("kept"))


def negative_stop(steps: DataFrame, episode: Sequence[str] = EPISODE, score: str = "score") -> DataFrame:
    """The first negative score ends the episode (``neg_step``, ``kept`` rows);
    its final score is 0 (``final_stop``) or, without the stop, the score before
    (``final_no_stop``)."""
    f = chunked(steps, list(episode), "step", 1, 0, lambda d, k: d.withColumn("_prev", F.coalesce(F.lag(score).over(w_ep(k)), F.lit(0.0))))
    neg = F.when(F.col(score) < 0, F.col("step"))
    g = f.groupBy(*episode).agg(F.min(neg).alias("neg_step"), F.min_by("_prev", neg).alias("_p"), F.count(F.lit(1)).alias("_n"))
    ended = F.col("neg_step").isNotNull()
    return g.select(*episode, "neg_step", F.when(ended, F.lit(0.0)).alias("final_stop"), F.when(ended, F.col("_p")).alias("final_no_stop"),
                    F.coalesce(F.col("neg_step") + 1, F.col("_n")).cast("long").alias("kept"))


def step_cap(steps: DataFrame, limit: int) -> DataFrame:
    """The loop stops at 2 x step limit."""
    return steps.where(F.col("step") < 2 * limit)


def finals(steps: DataFrame, limit: int = 100, loop_k: int | None = fixed.LOOP_WINDOW,
           stall_k: int | None = None, no_stop: bool = False, episode: Sequence[str] = EPISODE,
           action: Column | str = "action", score: str = "score") -> DataFrame:
    """One row per episode: the step where the loop ended (first of:
    negative score, loop rule, stall rule, step cap, last step) and the
    final score there.  A negative score ends first; its final score is 0
    (or the previous score with ``no_stop``)."""
    reach = max(1, (loop_k or 1) - 1, (stall_k or 1) - 1)

    def flags(d, keys):
        ends = [F.when(F.col(score) < 0, F.col("step"))]
        if loop_k:
            ends.append(F.when(loop_flag(loop_k, action, keys), F.col("step")))
        if stall_k:
            ends.append(F.when(stall_flag(stall_k, score, keys), F.col("step")))
        ends.append(F.when(F.col("step") == 2 * limit - 1, F.col("step")))
        prev = F.coalesce(F.lag(score).over(w_ep(keys)), F.lit(0.0))
        return d.withColumn("_end", F.least(*ends)).withColumn("_prev", prev)

    df = chunked(steps, list(episode), "step", reach, 0, flags)
    keep = [c for c in ("task_no",) if c in steps.columns and c not in episode]
    # the row at the first end, else the last row: partial aggregates only
    row = F.struct("step", F.col(score).alias("score"), "_prev")
    ended = df.groupBy(*episode, *keep).agg(
        F.min_by(row, F.col("_end")).alias("_at"), F.min("_end").alias("_first"), F.max_by(row, "step").alias("_last"),
        F.min(F.when(F.col(score) < 0, F.col("step"))).alias("neg_step"))
    ended = ended.withColumn("_row", F.when(F.col("_first").isNotNull(), F.col("_at")).otherwise(F.col("_last")))
    neg_final = F.lit(0.0) if not no_stop else F.col("_row._prev")
    fs = F.when(F.col("neg_step") == F.col("_row.step"), neg_final).otherwise(F.col("_row.score"))
    return ended.select(*episode, *keep, F.col("_row.step").alias("end_step"), fs.alias("final_score"))


# --- W14: sub-goal segment markers ----------------------------------------------------

def insert_markers(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """After a step whose successor has a different sub-goal, insert an
    ``end subgoal`` / ``the current subgoal is done.`` row copying score,
    look, inventory and sub-goal; ``step`` is renumbered.  The new number is
    the old one plus the markers before it (a running sum in chunks), so no
    second sort is needed."""
    df = chunked(steps, list(episode), "step", 0, 1, lambda d, k: d.withColumn("_nxt", F.lead("subgoal").over(w_ep(k))), keep=True)
    df = df.withColumn("_chg", (F.col("_nxt").isNotNull() & (F.col("_nxt") != F.col("subgoal"))).cast("int")).drop("_nxt")
    df = running_sum(df, list(episode), "step", "_chg", "_incl")
    own = (F.col("step") + F.col("_incl") - F.col("_chg")).cast(df.schema["step"].dataType)
    rows = F.when(F.col("_chg") == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = df.withColumn("step", own).withColumn("is_marker", F.explode(rows))
    mark = lambda text, c: F.when(F.col("is_marker"), F.lit(text)).otherwise(F.col(c))
    return (out.withColumn("step", F.col("step") + F.col("is_marker").cast(df.schema["step"].dataType))
            .withColumn("action", mark(fixed.MARKER_ACTION, "action")).withColumn("observation", mark(fixed.MARKER_OBSERVATION, "observation"))
            .drop("_chg", "_incl", "_chunk"))


# --- W15: running exact match -------------------------------------------------------------

def blocked_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], values: dict[str, Column],
                        block_of: Column | None = None) -> DataFrame:
    """Running sums of ``values`` over ``group`` in ``order`` (inclusive of
    the current row) without sorting a whole group in one task.

    A row's block rises with ``order``: blocks of nearly equal depth whatever the
    order columns hold (``depth_blocks``), or ``block_of`` where positions are dense.
    Per-block totals are prefix-summed over a small table (one row per group and
    block), joined back, and added to a running sum *within* each (group, block)
    partition, so a group holding a third of all rows is spread over its blocks."""
    d = depth_blocks(df, group, order) if block_of is None else df.withColumn("_blk", block_of)
    if block_of is None and all_short(d):
        one = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(v).over(one).alias(k) for k, v in values.items()])
    d = d.drop("_nb") if block_of is None else d
    tot = d.groupBy(*group, "_blk").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    wb = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*group, "_blk", *[F.coalesce(F.sum(f"_t_{k}").over(wb), F.lit(0)).alias(f"_o_{k}") for k in values])
    wi = Window.partitionBy(*group, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = d.join(offs, [*group, "_blk"], "inner")
    for k, v in values.items():
        j = j.withColumn(k, F.col(f"_o_{k}") + F.sum(v).over(wi))
    return j.drop("_blk", *[f"_o_{k}" for k in values])


def running_match(pairs: DataFrame, group: str = "task_no", order: Sequence[str] = ("variation_id", "step"),
                  pred: str = "prediction", target: str = "target") -> DataFrame:
    """Cumulative exact-match % after each row, per group (a task
    file), in the order of (episode, step): totals of the chunks of each episode are
    summed up in blocks of nearly equal depth, whatever the ids, and added to the
    running sum inside the chunk, so neither a task nor an episode is one sort."""
    episode, step = order
    m = pairs.withColumn("_m", F.col(pred).eqNullSafe(F.col(target)).cast("long")).withColumn("_c", F.floor(F.col(step) / BLOCK))
    # totals of every chunk of an episode, summed up over the episodes before in blocks of episodes
    tot = m.groupBy(group, episode, "_c").agg(F.sum("_m").alias("_tm"), F.count(F.lit(1)).alias("_tn"))
    tot = blocked_running_sum(tot, [group], [episode, "_c"], {"_sm": F.col("_tm"), "_sn": F.col("_tn")})
    ahead = tot.select(group, episode, "_c", (F.col("_sm") - F.col("_tm")).alias("_am"), (F.col("_sn") - F.col("_tn")).alias("_an"))
    inside = Window.partitionBy(group, episode, "_c").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    r = m.join(ahead, [group, episode, "_c"]).withColumn("_cm", F.col("_am") + F.sum("_m").over(inside)).withColumn("_cn", F.col("_an") + F.count(F.lit(1)).over(inside))
    return r.withColumn("running_match", F.col("_cm") * 100.0 / F.col("_cn")).drop("_m", "_c", "_cm", "_cn", "_am", "_an")


# --- W16 - W18: history clean-up ------------------------------------------------------------

def clean_history(steps: DataFrame, episode: Sequence[str] = EPISODE, score: str = "score") -> DataFrame:
    """Remove ``examine*``; ``teleport``->``go`` when score >= 0 and
    ``go``->``teleport`` when score < 0 (action and observation, every
    occurrence); remove ``open door*`` when score < 0; remove a row whose
    (rewritten) action recurs in the next 2 raw actions when score >= 0."""
    w = w_ep(episode)
    a, o, s = F.col("action"), F.col("observation"), F.col(score)
    t2g = a.startswith("teleport to") & (s >= 0)
    a1 = F.when(t2g, F.replace(a, F.lit("teleport"), F.lit("go"))).otherwise(a)
    o1 = F.when(t2g, F.replace(o, F.lit("teleport"), F.lit("go"))).otherwise(o)
    g2t = a1.startswith("go to") & (s < 0)
    a2 = F.when(g2t, F.replace(a1, F.lit("go"), F.lit("teleport"))).otherwise(a1)
    o2 = F.when(g2t, F.replace(o1, F.lit("go"), F.lit("teleport"))).otherwise(o1)
    n1, n2 = F.lead("action", 1).over(w), F.lead("action", 2).over(w)
    recur = ((F.coalesce(n1 == a2, F.lit(False)) | F.coalesce(n2 == a2, F.lit(False))) & (s >= 0))
    drop = a.startswith("examine") | (a2.startswith("open door") & (s < 0)) | recur
    return (steps.withColumn("_drop", drop).withColumn("_a", a2).withColumn("_o", o2)
            .where(~F.col("_drop")).drop("action", "observation", "_drop")
            .withColumnRenamed("_a", "action").withColumnRenamed("_o", "observation"))


def collapse_repeats(steps: DataFrame, before: int = 5, after: int = 4, episode: Sequence[str] = EPISODE,
                     line: str = "Repeat the above action for {} times.", counted: Column | None = None) -> DataFrame:
    """Drop a step whose action occurs in the previous ``before`` and in
    the next ``after`` actions (not the last row); each kept row reports in
    ``repeat_line`` how many rows were dropped right before it (emitted after
    it, as in the original; a trailing dropped run is never reported).
    Form A: before 5, after 4.  Form B: before 5, after 5 and the line
    ``Repeat the above {} times.``  Rows for which ``counted`` is false are left out
    of the result and of the counts, but are context of the other rows."""
    def flag(d, keys):
        w = w_ep(keys)
        prev = F.collect_list("action").over(w.rowsBetween(-before, -1))
        nxt = F.collect_list("action").over(w.rowsBetween(1, after))
        dropped = F.lead("_i").over(w).isNotNull() & F.array_contains(prev, F.col("action")) & F.array_contains(nxt, F.col("action"))
        return d.withColumn("_d", dropped.cast("int"))

    # positions are counted again: an earlier filter may have left gaps in ``step``
    f = chunked(renumber(steps, list(episode), "step", "_i"), list(episode), "_i", before, after, flag)
    if counted is not None:
        f = renumber(f.where(counted).withColumnRenamed("_i", "_j"), list(episode), "_j", "_i").drop("_j")
    # a kept row's position among the kept rows tells how many dropped rows lie between two of them
    kept = renumber(f.where("_d = 0"), list(episode), "_i", "_k")
    gone = F.col("_i") - F.col("_k")
    kept = chunked(kept, list(episode), "_k", 1, 0, lambda d, k: d.withColumn("repeats", (gone - F.coalesce(F.lag(gone).over(w_ep(k, "_k")), F.lit(0))).cast("int")))
    pre, post = line.split("{}")
    return kept.withColumn(
        "repeat_line", F.when(F.col("repeats") > 0, F.concat(F.lit(pre), F.col("repeats").cast("string"), F.lit(post)))).drop("_d", "_i", "_k")


def collapse_moves(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """Observations ``You go/teleport to the`` read as ``move to``;
    ``The door is already open.`` rows are dropped; of consecutive
    ``move to the`` rows only the last is kept."""
    o = F.col("observation")
    moved = o.startswith("You move to the") | o.startswith("You go to the") | o.startswith("You teleport to the")
    norm = F.when(moved, F.replace(F.replace(o, F.lit("go to"), F.lit("move to")), F.lit("teleport to"), F.lit("move to"))).otherwise(o)
    s = steps.withColumn("observation", norm).where(F.col("observation") != "The door is already open.")
    s = chunked(renumber(s, list(episode), "step", "_i"), list(episode), "_i", 0, 1,
                lambda d, k: d.withColumn("_nxt", F.lead("observation").over(w_ep(k, "_i")))).drop("_i")
    both = F.col("observation").contains("move to the") & F.coalesce(F.col("_nxt").contains("move to the"), F.lit(False))
    return s.where(~both).drop("_nxt")
