"""History prompts (C13-C15) as table jobs over steps.

Each prompt's variable part is built with chunked windows over the episode (the
clean-up and collapse rules W16-W18); lines are numbered by running sums in
chunks, and only the rows of the last lines are gathered.  What the prompt says of
the present (look, inventory, things focused on, error messages, last look of
every room) are partial aggregates.  The instruction text around it is the caller's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.actions import formalize
from ..functions.text import clean_look, current_room, focus_targets
from ..session import cut
from . import windows as W
from .blocks import chunk_of, chunked, renumber, running_sum
from .filters import failed_col

EPISODE = ("task_no", "variation_id")
LINES = fixed.PROMPT_LINES


def _counted(df: DataFrame, episode: Sequence[str], index: str, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` up to the row, in chunks of ``index``."""
    return running_sum(df.withColumn("_chunk", chunk_of(df, index)), list(episode), index, value, name).drop("_chunk")


def _gathered(df: DataFrame, episode: Sequence[str], name: str, last: int | None) -> DataFrame:
    """The lines ``_l`` of each episode's rows (``_upto``: lines up to the row) in order of
    step; with ``last`` only rows that write one of the last lines are gathered."""
    if last is not None:
        total = df.groupBy(*episode).agg(F.max("_upto").alias("_total"))
        df = df.join(total, list(episode)).where(F.col("_upto") > F.col("_total") - last)
    g = df.groupBy(*episode).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "_l"))), lambda x: x["_l"])).alias("_all"))
    lines = F.col("_all") if last is None else F.slice("_all", F.greatest(F.size("_all") - last + 1, F.lit(1)), last)
    return g.select(*episode, F.array_join(lines, "\n").alias(name))


def history_block(steps: DataFrame, k: int = 10, episode: Sequence[str] = EPISODE, demos: DataFrame | None = None) -> DataFrame:
    """C13 core: history lines of the next-actions prompt for the final state
    of each episode: W16 clean-up as for a score of -1 in every row (this prompt
    knows no scores), per kept row ``- (in <room>) Action: <FORMAL> --> <obs>``,
    W17 form A repeat lines after the row that follows a dropped run, the last
    ``k`` lines.  Rows observed as ``N/A``, without a formal action, or of a type that
    the task's demonstration (``demos``: task_no, demo; F10) lacks write no line; they
    are left out before the repeat test but stay context of it."""
    s = steps.withColumn("_loc", current_room("freelook")).withColumn("_minus", F.lit(-1.0))
    formal = F.coalesce(formalize("action"), F.lit("None"))
    shown = (F.col("observation") != "N/A") & (F.instr(formal, "(") > 0)
    s = chunked(s, list(episode), "step", 0, 2, lambda d, keys: W.clean_history(d, keys, "_minus"))
    if demos is not None:      # one row for each of the 30 tasks
        s = s.join(F.broadcast(demos.select("task_no", F.col("demo").alias("_demo"))), "task_no")
        shown = shown & F.col("_demo").contains(F.substring_index(formal, "(", 1))
    s = W.collapse_repeats(s, 5, 4, episode, counted=shown)
    fa = F.coalesce(formalize("action"), F.lit("None"))
    line = F.concat(F.lit("- (in "), F.coalesce(F.col("_loc"), F.lit("None")), F.lit(") Action: "), fa,
                    F.lit(" --> "), F.col("observation"))
    lines = F.when(F.col("repeat_line").isNotNull(), F.array(line, F.col("repeat_line"))).otherwise(F.array(line))
    # each kept row writes 1 or 2 lines
    s = s.withColumn("_l", lines).withColumn("_nl", F.size("_l").cast("long")).where("_l is not null")
    return _gathered(_counted(s, episode, "step", "_nl", "_upto"), episode, "history", k)


def plan_observations(steps: DataFrame, lite: bool = True, keep_last: int = 15,
                      episode: Sequence[str] = EPISODE) -> DataFrame:
    """C14 core: the observation list of the planning prompt.

    Per step: ``go to``/``teleport to`` observations read
    as ``move to``; ``The door is already open.`` is skipped; in the lite
    form a repeated ``In <room>, <obs>`` line is skipped; a step whose
    action occurs in the previous 5 and the next 5 actions is dropped and
    counted (W17 form B, ``Repeat the above n times.`` after the next kept
    line); move observations are written bare, others as
    ``In <room>, <obs>`` (lite) or ``In <room>, <action> --> <obs>``; of
    consecutive move lines only the last stays (W18); ``a substance called``
    reads ``there is a``; lines are numbered ``- n. ``; lite keeps the last
    ``keep_last``."""
    ep = list(episode)
    o = F.col("observation")
    moved = o.startswith("You move to the") | o.startswith("You go to the") | o.startswith("You teleport to the")
    obs = F.when(moved, F.replace(F.replace(o, F.lit("go to"), F.lit("move to")), F.lit("teleport to"), F.lit("move to"))).otherwise(o)

    def repeated(d, keys):
        w = W.w_ep(keys)
        around = F.collect_list("action").over(w.rowsBetween(-5, -1)), F.collect_list("action").over(w.rowsBetween(1, 5))
        return d.withColumn("_rep", F.array_contains(around[0], F.col("action")) & F.array_contains(around[1], F.col("action")))

    s = steps.withColumn("_loc", F.coalesce(current_room("freelook"), F.lit("None"))).withColumn("_obs", obs)
    s = chunked(s, ep, "step", 5, 5, repeated).where(F.col("_obs") != "The door is already open.")
    is_move = F.col("_obs").contains("move to the")
    short = F.concat(F.lit("In "), F.col("_loc"), F.lit(", "), F.col("_obs"))
    if lite:
        # a row whose ``In <room>, <obs>`` line is already written is skipped
        # before the repeat test (it is neither written nor counted); the
        # line was written iff an earlier non-repeat row had it
        s = s.withColumn("_key", F.when(~is_move, F.md5(short)))
        first = s.where("_key is not null and not _rep").groupBy(*ep, "_key").agg(F.min("step").alias("_first"))
        s = s.join(first, [*ep, "_key"], "left").where("_first is null or step <= _first").drop("_key", "_first")
    long = F.concat(F.lit("In "), F.col("_loc"), F.lit(", "), F.col("action"), F.lit(" --> "), F.col("_obs"))
    s = s.withColumn("_line", F.when(is_move, F.col("_obs")).otherwise(short if lite else long))
    # rows dropped as repeats between two written rows (rows skipped for the
    # door or as duplicates do not count)
    s = _counted(renumber(s, ep, "step", "_i").withColumn("_r", F.col("_rep").cast("long")), ep, "_i", "_r", "_reps")
    kept = renumber(s.where(~F.col("_rep")), ep, "_i", "_k")

    def neighbours(d, keys):
        w = W.w_ep(keys, "_k")
        return (d.withColumn("_n", F.col("_reps") - F.coalesce(F.lag("_reps").over(w), F.lit(0)))
                .withColumn("_next", F.lead("_line").over(w)))

    kept = chunked(kept, ep, "_k", 1, 1, neighbours)
    kept = kept.withColumn("_rl", F.when(F.col("_n") > 0, F.concat(F.lit("Repeat the above "), F.col("_n").cast("string"), F.lit(" times."))))
    # W18 on the written lines: a move line is dropped when the next written
    # line is a move line too.  A row's next line is its own repeat line if
    # it has one (never a move line), else the next kept row's line.
    drop_main = (F.col("_line").contains("move to the") & F.col("_rl").isNull()
                 & F.coalesce(F.col("_next").contains("move to the"), F.lit(False)))
    kept = kept.withColumn("_main", ~F.coalesce(drop_main, F.lit(False)))
    kept = kept.withColumn("_nl", F.col("_main").cast("long") + F.col("_rl").isNotNull().cast("long"))
    kept = _counted(kept, ep, "_k", "_nl", "_upto")
    first_no = F.col("_upto") - F.col("_nl") + 1

    def numbered(no, text):
        return F.concat(F.lit("- "), no.cast("string"), F.lit(". "), F.replace(text, F.lit("a substance called"), F.lit("there is a")))

    main = F.when(F.col("_main"), numbered(first_no, F.col("_line")))
    rep = F.when(F.col("_rl").isNotNull(), numbered(first_no + F.col("_main").cast("long"), F.col("_rl")))
    kept = kept.withColumn("_l", F.filter(F.array(main, rep), lambda x: x.isNotNull()))
    return _gathered(kept, ep, "observations", keep_last if lite else None)


# --- what the prompts say of the present -----------------------------------------

def situation(steps: DataFrame, episode: Sequence[str] = EPISODE) -> DataFrame:
    """One row per episode: ``look``, ``inventory``, ``loc`` and ``task_desc`` of the last
    step; ``messages``, the distinct failure texts (U4), sorted; ``focused``, the
    focus actions that did not fail, in order of their first time; ``visited``, the
    last look of every other room, in the order in which the rooms came."""
    s = steps.withColumn("_loc", current_room("freelook")).withColumn("_bad", failed_col("observation"))
    now = F.struct("freelook", "inventory", "_loc", *(["task_desc"] if "task_desc" in steps.columns else []))
    last = s.groupBy(*episode).agg(F.max_by(now, "step").alias("_now"),
                                   F.array_sort(F.collect_set(F.when(F.col("_bad"), F.col("observation")))).alias("messages"))
    focus = (s.where(F.col("action").startswith("focus on") & ~F.col("_bad")).groupBy(*episode, "action").agg(F.min("step").alias("_at"))
             .groupBy(*episode).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "action"))), lambda x: x["action"]).alias("focused")))
    # an episode has at most as many rows here as there are rooms
    rooms = (s.where("_loc is not null").groupBy(*episode, "_loc").agg(F.min("step").alias("_at"), F.max_by("freelook", "step").alias("_look"))
             .groupBy(*episode).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_loc").alias("room"), F.col("_look").alias("look")))).alias("_rooms")))
    j = last.join(focus, list(episode), "left").join(rooms, list(episode), "left")
    others = F.filter("_rooms", lambda r: ~r["room"].eqNullSafe(F.col("_now._loc")))
    return j.select(*episode, F.col("_now.freelook").alias("look"), F.col("_now.inventory").alias("inventory"), F.col("_now._loc").alias("loc"),
                    *([F.col("_now.task_desc").alias("task_desc")] if "task_desc" in steps.columns else []), "messages",
                    F.coalesce("focused", F.array().cast("array<string>")).alias("focused"), others.alias("visited"))


def _said(label: str, text: Column) -> Column:
    return F.concat(F.lit(LINES[label]), text)


def _focus_line() -> Column:
    things = F.array_join(F.transform("focused", lambda x: F.replace(x, F.lit("focus on"), F.lit(""))), ", ")
    return F.when(F.size("focused") > 0, _said("focused", things)).otherwise(F.lit(LINES["not_focused"]))


def _messages() -> Column:
    return F.when(F.size("messages") > 0, F.concat(F.lit(LINES["messages"] + "\n"), F.array_join("messages", "\n")))


def _once(steps: DataFrame, episode: Sequence[str]) -> DataFrame:
    """What the prompts need of the steps, written once: it is read by several jobs."""
    known = [c for c in ("task_no", "_nb") if c in steps.columns and c not in episode]
    return cut(steps.select(*episode, *known, "step", "action", "observation", "freelook", "inventory", "task_desc"), "prompt-steps")


def _prompt(parts: Sequence[Column | None], intro: Sequence[str], ask: Sequence[str]) -> Column:
    """Lines in order; a part that is null is left out."""
    return F.concat_ws("\n", *map(F.lit, intro), *(p for p in parts if p is not None), *map(F.lit, ask)).alias("prompt")


def next_actions_prompt(steps: DataFrame, demos: DataFrame, k: int = 10, episode: Sequence[str] = EPISODE, advice: DataFrame | None = None,
                        action_types: Sequence[tuple[str, str]] = (), intro: Sequence[str] = (), ask: Sequence[str] = ()) -> DataFrame:
    """The next-actions prompt at the end of each episode: the task's
    demonstration (``demos``: task_no, demo), the task, the last ``k`` history lines
    (``history_block``), what was focused on, error messages, the ``advice`` (keys,
    advice) of a planner, look and inventory, the ``action_types`` (name with
    arguments, description) that the demonstration holds, and the focus targets
    (X10).  ``steps`` carries ``task_desc``; ``intro`` and ``ask`` are the instruction
    lines around it."""
    s = situation(steps, episode).join(F.broadcast(demos.select("task_no", "demo")), "task_no", "left") if "task_no" in episode else         situation(steps, episode).join(steps.select(*episode, "task_no").distinct(), list(episode)).join(F.broadcast(demos.select("task_no", "demo")), "task_no", "left")
    s = s.join(history_block(steps, k, episode, demos), list(episode), "left")
    told = None
    if advice is not None:
        s = s.join(advice.select(*episode, "advice"), list(episode), "left")
        told = F.when(F.col("advice").isNotNull(), F.concat(F.lit(LINES["advice"] + "\n"), F.replace("advice", F.lit("Question"), F.lit("Advice"))))
    types = [F.when(F.col("demo").contains(name.split("(")[0]), F.lit(f"- {name} : {text} ")) for name, text in action_types]
    parts = [_said("example_next", F.col("demo")), _said("task_next", F.replace("task_desc", F.lit("Your"), F.lit("my"))),
             F.lit(LINES["history"].format(k)), F.col("history"), _focus_line(), _messages(), told,
             F.concat(F.lit(LINES["environment"]), clean_look("look"), F.lit("\n"), F.col("inventory")),
             *([F.lit(LINES["types"]), *types] if types else []),
             F.concat(F.lit(LINES["targets_next"]), F.array_join(focus_targets("task_desc", find=False), ", "), F.lit(" . "))]
    return s.select(*episode, _prompt(parts, intro, ask))


def plan_prompt(steps: DataFrame, demos: DataFrame, lite: bool = True, keep_last: int = 15, episode: Sequence[str] = EPISODE,
                fast_actions: DataFrame | None = None, intro: Sequence[str] = (), ask: Sequence[str] = ()) -> DataFrame:
    """C14: the planning prompt at the end of each episode: demonstration, task,
    observation list (``plan_observations``), in the full form the last look of the
    other rooms visited, the current location, inventory, what was focused on, the
    ``fast_actions`` (keys, action) of a small model, error messages and focus
    targets.  Arguments as of ``next_actions_prompt``."""
    steps = _once(steps, episode)
    s = situation(steps, episode)
    if "task_no" not in episode:
        s = s.join(steps.select(*episode, "task_no").distinct(), list(episode))
    s = (s.join(F.broadcast(demos.select("task_no", "demo")), "task_no", "left")
         .join(plan_observations(steps, lite, keep_last, episode), list(episode), "left"))
    instinct = None
    if fast_actions is not None:
        s = s.join(fast_actions.select(*episode, F.col("action").alias("_fast")), list(episode), "left")
        before, after = LINES["instinct"].split("{}")
        instinct = F.when(F.col("_fast").isNotNull(), F.concat(F.lit(before), F.col("_fast"), F.lit(after)))
    looks = F.array_join(F.transform("visited", lambda r: F.concat(F.lit("In "), r["room"], F.lit(": "), clean_look(r["look"], lite=True))), "\n")
    visited = None if lite else F.when(F.size("visited") > 0, F.concat(F.lit(LINES["visited"] + "\n"), looks))
    parts = [_said("example_plan", F.col("demo")), _said("task_plan", F.replace("task_desc", F.lit("Your"), F.lit("my"))),
             F.lit(LINES["observations"]), F.col("observations"), visited, _said("here", clean_look("look")),
             F.replace("inventory", F.lit("Your "), F.lit("My ")), _focus_line(), instinct, _messages(),
             F.concat(F.lit(LINES["targets_plan"]), F.array_join(focus_targets("task_desc", find=False), ", "), F.lit("!"))]
    return s.select(*episode, _prompt(parts, intro, ask))


def candidate_prompt(cands: DataFrame, ctx: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate-list prompt for a prediction that is not valid
    (``ctx`` carries keys, freelook, inventory, goal, action)."""
    lst = cands.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set("action")),
                                                            lambda a: F.concat(F.lit("- "), a)), "\n").alias("_list"))
    j = ctx.join(lst, list(keys))
    text = F.concat_ws("\n", F.lit(fixed.SELECT_INTRO), clean_look("freelook"), F.col("inventory"), F.lit(fixed.SELECT_LIST),
                       F.col("_list"),
                       F.concat(F.lit("\n I want to achieve this goal: "), F.col("goal"), F.lit(" but my action '"),
                                F.col("action"), F.lit("' is not in the candidate list.")),
                       F.lit(fixed.SELECT_ASK), F.lit("Selected action:"))
    return j.select(*keys, text.alias("prompt"))
