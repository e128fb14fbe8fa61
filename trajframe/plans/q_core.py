"""Registered queries: filters, windows, aggregates, sampling, sets.

Each query binds an operator to the driver tables (FIXTURES.md §2) and has
an independent DuckDB formulation.  Parameters that make a rule bind on the
small fixtures (caps 2/3, k=5, limit 3, ...) are the ones FIXTURES lists.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.actions import formalize
from ..operators import aggregates as A
from ..operators import filters as FL
from ..operators import sampling as T
from ..operators import windows as W
from ..operators.compose import RECIPES, compose
from ..operators.joins import drop_invalid_focus, exclude_recent, extend_valid, with_real_id
from ..operators.blocks import BLOCK
from ..sources.tables import task_dimension
from .catalog import query
from .q_compose import HIST_STATE, ROOMS_CTE, SG_CTE, hist_cte
from .sqlviews import formalize_sql, strip_sql, trunc100_sql, with_views, with_views_rec
from .views import over_chunks, v_cands, v_eps, v_f, v_f_plain, v_pairs, v_steps, with_tasks

EP = ["task_no", "variation_id"]

# ============================================================== filters (F)

query("filter_noise_steps", with_views("select task_no, variation_id, pos, step, action from v_f"))(
    lambda spark, sf: v_f_plain(spark, sf, position=True).select("task_no", "variation_id", "pos", "step", "action"))

query("filter_short_episodes", with_views(
    "select task_no, variation_id, step from v_f where variation_id in "
    "(select variation_id from v_f group by 1 having count(*) >= 40)"))(
    lambda spark, sf: W.min_steps(v_f_plain(spark, sf), 40).select("task_no", "variation_id", "step"))

query("filter_fold", with_views("select task_no, variation_id, step, fold from v_f where fold = 'test'"))(
    lambda spark, sf: FL.by_fold(v_f_plain(spark, sf), "test").select("task_no", "variation_id", "step", "fold"))

query("filter_failed_obs", with_views(
    "select variation_id, pos, observation, (observation = 'No known action matches that input.' "
    "or contains(observation, 'can''t') or contains(observation, 'not') or contains(observation, 'doesn''t')) as failed "
    "from v_steps"))(
    lambda spark, sf: FL.flag_failed(v_steps(spark, sf)).select("variation_id", "pos", "observation", "failed"))


def raw_task_names(spark, sf):
    """Raw corpus task names per episode: ``task-<n>-(<name>)`` for even task
    numbers (with the old ``mendelian`` spelling), the bare name otherwise."""
    e = v_eps(spark, sf).join(F.broadcast(task_dimension(spark)), "task_no")
    old = F.replace(F.col("task_name"), F.lit("mendellian"), F.lit("mendelian"))
    raw = F.when(F.col("task_no") % 2 == 0,
                 F.concat(F.lit("task-"), F.col("task_no").cast("string"), F.lit("-("), old, F.lit(")"))).otherwise(old)
    return e.select("variation_id", "task_no", raw.alias("raw_name"))


RAW_NAMES_SQL = """
eps as (select distinct variation_id, task_no, fold from v_steps),
raw as (select e.variation_id, e.task_no,
          case when e.task_no % 2 = 0 then concat('task-', cast(e.task_no as varchar), '-(', replace(t.task_name, 'mendellian', 'mendelian'), ')')
               else replace(t.task_name, 'mendellian', 'mendelian') end as raw_name
        from eps e join tasks t on e.task_no = t.task_no)"""
NORMALISE_SQL = ("case when starts_with(raw_name, 'task') then translate(regexp_replace(raw_name, '^[^-]*-[^-]*-', ''), '()', '') "
                 "else raw_name end")

query("project_task_name", with_views(f"select variation_id, raw_name, {NORMALISE_SQL} as task_name from raw", RAW_NAMES_SQL))(
    lambda spark, sf: raw_task_names(spark, sf).select(
        "variation_id", "raw_name", FL.normalise_task_col("raw_name").alias("task_name")))

query("join_task_dim", with_views(
    f"select r.variation_id, r.raw_name, t.task_real_id, split_part(t.task_real_id, '-', 1) as task_group "
    f"from raw r left join tasks t on replace({NORMALISE_SQL}, 'mendelian', 'mendellian') = t.task_name", RAW_NAMES_SQL))(
    lambda spark, sf: with_real_id(raw_task_names(spark, sf), task_dimension(spark), "raw_name")
    .select("variation_id", "raw_name", "task_real_id", "task_group"))

query("project_step_io", with_views(
    "select variation_id, step, action, prev_action, prev_observation, inventory from ("
    "select *, lag(action) over w as prev_action, lag(observation) over w as prev_observation from v_f "
    "window w as (partition by variation_id order by step)) where step >= 1"))(
    lambda spark, sf: over_chunks(spark, sf, lambda d, k: W.step_io(d, k), 1, 0).select(
        "variation_id", "step", "action", "prev_action", "prev_observation", "inventory"))


def _focus_cands(spark, sf):
    f = v_f_plain(spark, sf).select("variation_id", "step", "freelook", "inventory")
    c = v_cands(spark, sf).withColumn("action", F.regexp_replace("action", "^examine ", "focus on "))
    return c.join(f, (c.variation_id == f.variation_id) & (f.step == c.grp * 5)).drop(f.variation_id)


FOCUS_CANDS_SQL = """
preds as (select variation_id, cast(floor(step / 5) as bigint) as grp, cast(step % 5 + 1 as int) as rnk, action from v_f),
cands as (select distinct variation_id, grp - 1 as grp, action from preds where grp >= 1),
fc as (select c.variation_id, c.grp, regexp_replace(c.action, '^examine ', 'focus on ') as action, f.freelook, f.inventory
       from cands c join v_f f on f.variation_id = c.variation_id and f.step = c.grp * 5)"""

query("filter_focus_visible", with_views(
    "select variation_id, grp, action from fc where not starts_with(action, 'focus on') or "
    "len(list_filter(string_split(regexp_replace(action, '(?i)\\b(?:focus|on|in|to)\\b', '', 'g'), ' '), "
    "lambda w: not contains(concat(freelook, ' ', lower(inventory)), w))) = 0", FOCUS_CANDS_SQL))(
    lambda spark, sf: FL.visible_focus(_focus_cands(spark, sf)).select("variation_id", "grp", "action"))

query("filter_door", with_views(
    "select distinct variation_id, action from v_steps where not (contains(action, 'door') and not contains(action, 'open'))"))(
    lambda spark, sf: FL.open_doors_only(v_steps(spark, sf).select("variation_id", "action").distinct()))

PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _sql_words(x: str) -> str:
    p = PUNCT.replace("'", "''")
    return f"list_filter(regexp_split_to_array(lower(translate({x}, '{p}', '')), '\\s+'), lambda w: w <> '')"


def _sql_items(prefix: str) -> str:
    return f"list_filter(regexp_split_to_array(replace(action, '{prefix}', ''), '\\s+'), lambda w: w <> '')"


query("filter_task_overlap", with_views(
    "select variation_id, task_no, action from (select distinct s.variation_id, s.task_no, s.action, t.task_desc "
    "from v_steps s join (select distinct task_no, task_desc from v_ft) t on s.task_no = t.task_no) "
    f"where not ((starts_with(action, 'focus on') and task_no not in (5,6,7,8,17,18,19,20) and not list_has_any({_sql_items('focus on')}, {_sql_words('task_desc')})) "
    f"or (starts_with(action, 'examine') and task_no not in (14,15,16) and not list_has_any({_sql_items('examine')}, {_sql_words('task_desc')})))"))(
    lambda spark, sf: FL.task_overlap(with_tasks(v_steps(spark, sf), spark)
                                      .select("variation_id", "task_no", "action", "task_desc").distinct())
    .select("variation_id", "task_no", "action"))


def _demos(spark, sf):
    f = v_f_plain(spark, sf)
    first = f.groupBy("task_no").agg(F.min("variation_id").alias("variation_id"))
    d = f.join(first, ["task_no", "variation_id"], "left_semi")
    return d.groupBy("task_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("step", F.coalesce(formalize("action"), F.lit("None")).alias("fa")))),
        lambda x: x["fa"]), "\n").alias("demo"))


def q_history_types(spark, sf):
    h = W.with_history_state(v_f_plain(spark, sf))
    h = h.select("task_no", "variation_id", "step", F.col("h_action").alias("action"), F.col("h_obs").alias("observation"))
    return FL.relevant_history(h, _demos(spark, sf), episode=("task_no",)).select("variation_id", "step", "action")


query("filter_history_types", with_views(f"""
select h.variation_id, h.step, h.h_action as action from h2 h join demos d on h.task_no = d.task_no
where h.h_obs <> 'N/A' and instr({formalize_sql('h.h_action')}, '(') > 0
  and contains(d.demo, split_part({formalize_sql('h.h_action')}, '(', 1))""", HIST_STATE, f"""
demos as (select f.task_no, string_agg(coalesce({formalize_sql('f.action')}, 'None'), chr(10) order by f.step) as demo
          from v_f f join (select task_no, min(variation_id) as variation_id from v_f group by 1) m
            on f.task_no = m.task_no and f.variation_id = m.variation_id group by 1)"""))(q_history_types)

# ============================================================== windows (W)


def q_win_history(spark, sf):
    def items(d, k):
        h, w = W.with_history_state(d, k), W.w_ep(k)
        return h.withColumn("last_item", F.concat(F.lag("h_action").over(w), F.lit(" --> "), F.lag("h_obs").over(w)))

    h = over_chunks(spark, sf, items, 2, 0)
    h = W.blocked_running_sum(h, EP, ["step"], {"_sum": F.col("reward")}, F.floor(F.col("step") / BLOCK))
    return h.where(F.col("step") >= 1).select("variation_id", "step", F.col("step").alias("n_items"), "last_item",
                                              (F.round(F.col("_sum") - F.col("reward"), 6) + F.lit(0.0)).alias("reward_sum"))


query("win_history", with_views(
    "select variation_id, step, count(*) over pre as n_items, concat(lag(h_action) over w, ' --> ', lag(h_obs) over w) as last_item, "
    "round(sum(reward) over pre, 6) + 0.0 as reward_sum from h2 "
    "window w as (partition by variation_id order by step), pre as (partition by variation_id order by step rows between unbounded preceding and 1 preceding) "
    "qualify step >= 1",
    HIST_STATE))(q_win_history)

query("win_reward", with_views(f"select variation_id, step, round(reward, 6) as reward, {trunc100_sql('reward')} as reward_pct from h2", HIST_STATE))(
    lambda spark, sf: over_chunks(spark, sf, lambda d, k: W.with_history_state(d, k), 1, 0).select(
        "variation_id", "step", F.round("reward", 6).alias("reward"), W.trunc100(F.col("reward")).alias("reward_pct")))

query("win_last_k", with_views("select h2.variation_id, h2.step, hist.history from h2 join hist using (variation_id, step) where h2.step >= 1",
                               HIST_STATE, hist_cte(10, False)))(
    lambda spark, sf: over_chunks(spark, sf, lambda d, k: W.add_history(W.with_history_state(d, k), 10, False, k), 11, 0)
    .where(F.col("step") >= 1).select("variation_id", "step", "history"))

query("win_next_subgoal", with_views("select variation_id, step, next_subgoal from h2", HIST_STATE))(
    lambda spark, sf: over_chunks(spark, sf, lambda d, k: W.with_next_subgoal(d, k), 0, 1).select(
        "variation_id", "step", "next_subgoal"))

query("win_subgoal_runs", with_views("select variation_id, step, n_sg, sg_all as subgoals from sgrun", HIST_STATE, SG_CTE))(
    lambda spark, sf: W.subgoal_runs(v_f_plain(spark, sf)).select(
        "variation_id", "step", F.size("subgoals").cast("long").alias("n_sg"), F.array_join("subgoals", ", ").alias("subgoals")))

query("win_returns_to_go", with_views(
    "select variation_id, step, round(1.0 - lag(score) over (partition by variation_id order by step), 2) as returns_to_go from v_f"))(
    lambda spark, sf: over_chunks(spark, sf, lambda d, k: W.with_history_state(d, k), 1, 0).select(
        "variation_id", "step", "returns_to_go"))

query("win_visited_rooms", with_views(
    "select h2.variation_id, h2.step, pl.places from h2 left join places pl using (variation_id, step) where h2.step >= 1",
    HIST_STATE, ROOMS_CTE))(
    lambda spark, sf: W.visited_rooms(v_f_plain(spark, sf)).where(F.col("step") >= 1).select(
        "variation_id", "step", F.when(F.size("places") > 0, F.array_join("places", ", ")).alias("places")))


def mentions_sql(x: str) -> str:
    t = x
    for a, b in [(",", "chr(10)"), (".", "chr(10)"), ("(", "chr(10)"), (")", "' '"), (" an ", "' a '")]:
        t = f"replace({t}, '{a}', {b})"
    strip_dots = "regexp_replace({}, '^\\.+|\\.+$', '', 'g')"
    item = strip_dots.format(strip_sql("translate(m, chr(10) || chr(9), '  ')"))
    return (f"list_transform(list_filter(regexp_extract_all({t}, '(?i)a .*?\\n', 0), lambda m: not contains(m, 'door')), "
            f"lambda m: {item})")


OBJ_LIMIT = 3


def objects_sql(limit: int) -> str:
    """``rec``: the FIFO of at most ``limit`` objects after each step."""
    return f"""
obj as (select variation_id, step, {mentions_sql('freelook')} as t from v_f),
rec as (
  select variation_id, step, []::varchar[] as st from obj where step = 0
  union all
  select o.variation_id, o.step,
    (with g as (select list_concat(r.st, list_filter(o.t, lambda x, i: not list_contains(r.st, x) and list_position(o.t, x) = i)) as gl)
     select case when len(gl) > {limit} then list_slice(gl, len(gl) - {limit} + 1, len(gl)) else gl end from g)
  from rec r join obj o on o.variation_id = r.variation_id and o.step = r.step + 1)"""


OBJECTS_SQL = objects_sql(OBJ_LIMIT)

query("win_seen_objects", with_views_rec("select variation_id, step, array_to_string(st, ', ') as objects from rec", OBJECTS_SQL))(
    lambda spark, sf: W.with_objects(v_f_plain(spark, sf), limit=OBJ_LIMIT).select(
        "variation_id", "step", F.array_join("objects", ", ").alias("objects")))

query("win_seen_objects_final", with_views_rec(
    "select variation_id, array_to_string(st, ', ') as objects from rec qualify step = max(step) over (partition by variation_id)",
    OBJECTS_SQL))(
    lambda spark, sf: W.final_objects(v_f_plain(spark, sf), OBJ_LIMIT).select(
        "variation_id", F.array_join("objects", ", ").alias("objects")))


LOOP_K = 5
query("win_loop_stop", with_views(f"""
select variation_id, min(case when fired then step end) as stop_step,
       count(*) filter (where step <= coalesce(s, 1 << 30)) as kept from (
  select *, min(case when fired then step end) over (partition by variation_id) as s from (
    select variation_id, step, step + 2 >= {LOOP_K} and len(list_distinct(case when step = {LOOP_K - 2}
             then list_prepend('look around', l) else l end)) = 2 as fired
    from (select variation_id, step, list(action) over (partition by variation_id order by step rows between {LOOP_K - 1} preceding and current row) as l from v_f)))
group by variation_id"""))(
    lambda spark, sf: W.stop_step(v_f_plain(spark, sf), lambda k: W.loop_flag(LOOP_K, "action", k), LOOP_K - 1, ["variation_id"]))

LOOP_WORD_K = 10
query("win_loop_stop_words", with_views(f"""
select variation_id, min(case when fired then step end) as stop_step,
       count(*) filter (where step <= coalesce(s, 1 << 30)) as kept from (
  select *, min(case when fired then step end) over (partition by variation_id) as s from (
    select variation_id, step, step + 2 >= {LOOP_WORD_K} and len(list_distinct(case when step = {LOOP_WORD_K - 2}
             then list_prepend('look around', l) else l end)) = 2 as fired
    from (select variation_id, step, list(split_part(action, ' ', 1)) over (partition by variation_id order by step rows between {LOOP_WORD_K - 1} preceding and current row) as l from v_f)))
group by variation_id"""))(
    lambda spark, sf: W.stop_step(v_f_plain(spark, sf), lambda k: W.loop_flag(LOOP_WORD_K, F.split("action", " ").getItem(0), k),
                                  LOOP_WORD_K - 1, ["variation_id"]))

STALL_K = 2
query("win_stall_stop", with_views(f"""
select variation_id, min(case when fired then step end) as stop_step,
       count(*) filter (where step <= coalesce(s, 1 << 30)) as kept from (
  select *, min(case when fired then step end) over (partition by variation_id) as s from (
    select variation_id, step, step + 2 > {STALL_K} and min(score) over w = max(score) over w as fired
    from v_f window w as (partition by variation_id order by step rows between {STALL_K - 1} preceding and current row)))
group by variation_id"""))(
    lambda spark, sf: W.stop_step(v_f_plain(spark, sf), lambda k: W.stall_flag(STALL_K, "score", k), STALL_K - 1, ["variation_id"]))

query("win_negative_stop", with_views("""
select variation_id, min(neg) as neg_step, max(case when step = n then prev end) as final_no_stop,
       max(case when step = n then 0.0::double end) as final_stop, count(*) filter (where step <= coalesce(n, 1 << 30)) as kept from (
  select *, min(neg) over (partition by variation_id) as n from (
    select variation_id, step, case when score < 0 then step end as neg,
           coalesce(lag(score) over (partition by variation_id order by step), 0.0) as prev from v_f))
group by variation_id"""))(
    lambda spark, sf: W.negative_stop(v_f_plain(spark, sf), ["variation_id"]))

STEP_LIMIT = 20
query("win_step_cap", with_views(f"select variation_id, step from v_f where step < 2 * {STEP_LIMIT}"))(
    lambda spark, sf: W.step_cap(v_f_plain(spark, sf), STEP_LIMIT).select("variation_id", "step"))

TEST_CAP = 2
query("win_test_fold_cap", with_views(f"""
select task_no, variation_id, fold from (
  select *, sum(case when fold = 'test' then 1 else 0 end) over (partition by task_no order by variation_id rows between unbounded preceding and current row) as c
  from (select distinct task_no, variation_id, fold from v_f)) where c < {TEST_CAP}"""))(
    lambda spark, sf: T.cap_test_episodes(v_eps(spark, sf), TEST_CAP))

def q_markers(spark, sf):
    return W.insert_markers(v_f_plain(spark, sf)).select("variation_id", "step", "action", "subgoal", "is_marker")


query("win_segment_markers", with_views("""
select variation_id, cast(step + before as int) as step, action, subgoal, false as is_marker from m
union all
select variation_id, cast(step + before + 1 as int) as step, 'end subgoal' as action, subgoal, true as is_marker from m where chg = 1""",
    """
m0 as (select *, case when lead(subgoal) over w is not null and lead(subgoal) over w <> subgoal then 1 else 0 end as chg
       from v_f window w as (partition by variation_id order by step)),
m as (select *, coalesce(sum(chg) over (partition by variation_id order by step rows between unbounded preceding and 1 preceding), 0) as before from m0)"""))(
    q_markers)

PAIRS_SQL = """
pairs as (select task_no, variation_id, step, action as prediction, lead(action) over (partition by variation_id order by step) as target
          from v_f qualify target is not null)"""

query("win_running_match", with_views("""
select task_no, variation_id, step, round(100.0 * sum(case when prediction = target then 1 else 0 end) over w / count(*) over w, 6) as running_match
from pairs window w as (partition by task_no order by variation_id, step rows between unbounded preceding and current row)""", PAIRS_SQL))(
    lambda spark, sf: W.running_match(v_pairs(spark, sf)).select(
        "task_no", "variation_id", "step", F.round("running_match", 6).alias("running_match")))

query("win_clean_history", with_views("""
select variation_id, step, a2 as action, o2 as observation from (
  select *, case when starts_with(a1, 'go to') and score < 0 then replace(a1, 'go', 'teleport') else a1 end as a2,
            case when starts_with(a1, 'go to') and score < 0 then replace(o1, 'go', 'teleport') else o1 end as o2 from (
    select *, case when starts_with(action, 'teleport to') and score >= 0 then replace(action, 'teleport', 'go') else action end as a1,
              case when starts_with(action, 'teleport to') and score >= 0 then replace(observation, 'teleport', 'go') else observation end as o1,
              lead(action, 1) over w as n1, lead(action, 2) over w as n2
    from v_f window w as (partition by variation_id order by step)))
where not (starts_with(action, 'examine') or (starts_with(a2, 'open door') and score < 0)
           or ((coalesce(n1 = a2, false) or coalesce(n2 = a2, false)) and score >= 0))"""))(
    lambda spark, sf: over_chunks(spark, sf, lambda d, k: W.clean_history(d, k), 0, 2).select(
        "variation_id", "step", "action", "observation"))

def q_repeat_collapse(spark, sf):
    return W.collapse_repeats(v_f_plain(spark, sf), 5, 4).select("variation_id", "step", "action", "repeats", "repeat_line")


query("win_repeat_collapse", with_views("""
select variation_id, step, action, cast(step - coalesce(lag(step) over w, first - 1) - 1 as int) as repeats,
       case when step - coalesce(lag(step) over w, first - 1) - 1 > 0
            then concat('Repeat the above action for ', cast(step - coalesce(lag(step) over w, first - 1) - 1 as varchar), ' times.') end as repeat_line
from (select *, min(step) over (partition by variation_id) as first from (
        select *, lead(step) over o is not null and coalesce(list_contains(list(action) over p, action), false)
                  and coalesce(list_contains(list(action) over n, action), false) as dropped
        from v_f window o as (partition by variation_id order by step),
                        p as (partition by variation_id order by step rows between 5 preceding and 1 preceding),
                        n as (partition by variation_id order by step rows between 1 following and 4 following))
      where not dropped)
window w as (partition by variation_id order by step)"""))(
    q_repeat_collapse)

query("win_move_collapse", with_views("""
select variation_id, step, observation from (
  select *, lead(observation) over (partition by variation_id order by step) as nxt from (
    select variation_id, step, case when starts_with(observation, 'You move to the') or starts_with(observation, 'You go to the')
              or starts_with(observation, 'You teleport to the') then replace(replace(observation, 'go to', 'move to'), 'teleport to', 'move to')
              else observation end as observation from v_f)
  where observation <> 'The door is already open.')
where not (contains(observation, 'move to the') and coalesce(contains(nxt, 'move to the'), false))"""))(
    lambda spark, sf: W.collapse_moves(v_f_plain(spark, sf)).select("variation_id", "step", "observation"))


def q_exclude_recent(spark, sf):
    recent = (over_chunks(spark, sf, lambda d, k: d.withColumn("_l", F.collect_list("action").over(W.w_ep(k).rowsBetween(-2, 0))), 2, 0)
              .where(F.col("step") % 5 == 4)
              .select("variation_id", F.floor(F.col("step") / 5).cast("long").alias("grp"), F.explode("_l").alias("action")))
    return exclude_recent(v_cands(spark, sf), recent, ["variation_id", "grp"])


query("win_exclude_recent", with_views("""
select c.variation_id, c.grp, c.action from cands c
where not exists (select 1 from v_f f where f.variation_id = c.variation_id and f.step between 5 * c.grp + 2 and 5 * c.grp + 4
                  and f.action = c.action and exists (select 1 from v_f g where g.variation_id = c.variation_id and g.step = 5 * c.grp + 4))""",
    FOCUS_CANDS_SQL))(q_exclude_recent)

# ============================================================== aggregates (A)

query("agg_variations_by_fold", with_views("""
select task_no, count(*) filter (where fold = 'train') as train, count(*) filter (where fold = 'dev') as dev,
       count(*) filter (where fold = 'test') as test from (select distinct task_no, variation_id, fold from v_steps) group by task_no"""))(
    lambda spark, sf: A.count_by_fold(v_eps(spark, sf)))


def _examples(spark, sf, recipe="action_formal"):
    return compose(v_f(spark, sf), RECIPES[recipe])


query("agg_examples_by_fold", with_views("""
select task_no, count(*) filter (where fold = 'train') as train, count(*) filter (where fold = 'dev') as dev,
       count(*) filter (where fold = 'test') as test from v_f where step >= 1 group by task_no"""))(
    lambda spark, sf: A.count_by_fold(_examples(spark, sf)))

query("agg_task_distribution", with_views(
    "select task_real_id, count(*) as n from v_ft where step >= 1 group by 1"))(
    lambda spark, sf: A.task_distribution(_examples(spark, sf).join(F.broadcast(task_dimension(spark)), "task_no")))

query("agg_label_verbs", with_views(
    f"select split_part({strip_sql('action')}, ' ', 1) as verb, count(*) as n from v_f where step >= 1 group by 1"))(
    lambda spark, sf: A.verb_distribution(_examples(spark, sf, "action_raw")))

query("agg_split_coverage", with_views("""
select task_group, array_to_string(list_sort(list(distinct fold)), ',') as splits, count(distinct fold) = 3 as complete
from v_ft where step >= 1 group by 1"""))(
    lambda spark, sf: A.split_coverage(_examples(spark, sf).join(F.broadcast(task_dimension(spark)), "task_no")))

FINALS_SQL = f"""
fin0 as (select *, coalesce(lag(score) over w, 0.0) as prev, case when score < 0 then step end as neg,
           least(case when score < 0 then step end,
                 case when step + 2 >= {LOOP_K} and len(list_distinct(case when step = {LOOP_K - 2} then list_prepend('look around', l) else l end)) = 2 then step end,
                 case when step = 2 * {STEP_LIMIT} - 1 then step end) as e
         from (select *, list(action) over (partition by variation_id order by step rows between {LOOP_K - 1} preceding and current row) as l from v_f)
         window w as (partition by variation_id order by step)),
fin1 as (select *, coalesce(min(e) over (partition by variation_id), max(step) over (partition by variation_id)) as end_step,
                min(neg) over (partition by variation_id) as neg_step from fin0),
finals as (select variation_id, task_no, end_step, case when neg_step = end_step then 0.0 else score end as final_score
           from fin1 where step = end_step)"""


def _finals(spark, sf):
    return W.finals(v_f_plain(spark, sf), limit=STEP_LIMIT, loop_k=LOOP_K)


query("agg_episode_final", with_views("select variation_id, task_no, end_step, round(final_score, 6) as final_score from finals", FINALS_SQL))(
    lambda spark, sf: _finals(spark, sf).select("variation_id", "task_no", "end_step", F.round("final_score", 6).alias("final_score")))

query("agg_mean_score", with_views(
    "select task_no, round(avg(final_score), 6) as mean_score, count(*) as episodes from finals group by 1", FINALS_SQL))(
    lambda spark, sf: A.mean_scores(_finals(spark, sf)).select("task_no", F.round("mean_score", 6).alias("mean_score"), "episodes"))

query("agg_exact_match", with_views(
    "select task_no, round(avg(case when prediction = target then 1.0 else 0.0 end) * 100, 6) as exact_match, count(*) as rows from pairs group by 1",
    PAIRS_SQL))(
    lambda spark, sf: A.exact_match(v_pairs(spark, sf)).select("task_no", F.round("exact_match", 6).alias("exact_match"), "rows"))


def _sg_pairs(spark, sf):
    f = W.with_next_subgoal(v_f_plain(spark, sf))
    # sub-goal predictions as an agent prints them: with a trailing dot and spaces
    return f.select("task_no", "variation_id", "step", F.concat(F.col("subgoal"), F.lit(". ")).alias("prediction"),
                    F.col("next_subgoal").alias("target"))


def _norm_sql(x):
    return f"regexp_replace({strip_sql(f'translate({x}, chr(10) || chr(9), chr(32) || chr(32))')}, '^\\.+|\\.+$', '', 'g')"


query("agg_exact_match_subgoal", with_views(
    f"select task_no, round(avg(case when {_norm_sql('prediction')} = {_norm_sql('target')} then 1.0 else 0.0 end) * 100, 6) as exact_match, "
    "count(*) as rows from (select task_no, concat(subgoal, '. ') as prediction, "
    "lead(subgoal, 1, 'complete_task()') over (partition by variation_id order by step) as target from v_f) group by 1"))(
    lambda spark, sf: A.exact_match(_sg_pairs(spark, sf), normalise=True).select(
        "task_no", F.round("exact_match", 6).alias("exact_match"), "rows"))

query("agg_subgoal_vocab", with_views("select distinct subgoal from v_f"))(
    lambda spark, sf: A.subgoal_vocab(v_f_plain(spark, sf)))

CAPS = {"train": 2000, "dev": 1000, "test": 5000}
query("agg_sample_counts", with_views(
    "select fold, count(*) as rows, least(count(*), case fold when 'train' then 2000 when 'dev' then 1000 when 'test' then 5000 end) as samples "
    "from v_f where step >= 1 group by 1"))(
    lambda spark, sf: A.sample_counts(_examples(spark, sf), CAPS))

FAILED_SQL = ("(observation = 'No known action matches that input.' or contains(observation, 'can''t') "
              "or contains(observation, 'not') or contains(observation, 'doesn''t'))")
query("set_error_messages", with_views(
    f"select variation_id, array_to_string(list_sort(list(distinct observation)), ' || ') as messages, count(*) as failures "
    f"from v_steps where {FAILED_SQL} group by 1"))(
    lambda spark, sf: A.failure_messages(v_steps(spark, sf), ["variation_id"]))

# ============================================================== sampling (T)

DS_RULES = [("9-", 2), ("10-", 2), ("3-3", 3)]


def _eps_real(spark, sf):
    return v_eps(spark, sf).join(F.broadcast(task_dimension(spark)), "task_no").select("task_real_id", "variation_id", "fold", "task_no")


def _md5_sql(*cols):
    return "md5(concat_ws('|', '1', " + ", ".join(f"cast({c} as varchar)" for c in cols) + "))"


EPS_REAL_SQL = """
eps_real as (select t.task_real_id, e.variation_id, e.fold, e.task_no from (select distinct task_no, variation_id, fold from v_steps) e
             join tasks t on e.task_no = t.task_no)"""

query("topk_downsample", with_views(f"""
select task_real_id, variation_id from (
  select *, row_number() over (partition by task_real_id order by {_md5_sql('variation_id')}, variation_id) as rn,
         case when starts_with(task_real_id, '9-') then 2 when starts_with(task_real_id, '10-') then 2
              when starts_with(task_real_id, '3-3') then 3 end as cap from eps_real)
where cap is null or rn <= cap""", EPS_REAL_SQL))(
    lambda spark, sf: T.downsample(_eps_real(spark, sf), DS_RULES, 1).select("task_real_id", "variation_id"))

MINI_N = 500
query("topk_mini_sample", with_views(
    f"select variation_id, step from v_f order by {_md5_sql('task_no', 'variation_id', 'step')}, task_no, variation_id, step limit {MINI_N}"))(
    lambda spark, sf: T.mini(v_f_plain(spark, sf), MINI_N, 1).select("variation_id", "step"))

GROUP_MINI = 20
query("topk_group_mini", with_views(
    f"select task_group, variation_id, step from v_ft qualify row_number() over (partition by task_group order by task_no, variation_id, step) <= {GROUP_MINI}"))(
    lambda spark, sf: T.first_per_group(v_f(spark, sf), ["task_group"], GROUP_MINI, ["task_no", "variation_id", "step"])
    .select("task_group", "variation_id", "step"))


def q_variation_policy(spark, sf):
    e = v_eps(spark, sf)
    parts = [T.pick_variations(e, "test", test_cap=2).withColumn("set", F.lit("test")),
             T.pick_variations(e, "dev").withColumn("set", F.lit("dev")),
             T.pick_variations(e, "test_mini_2").withColumn("set", F.lit("test_mini_2")),
             T.pick_variations(e, "test_mini").withColumn("set", F.lit("test_mini")),
             T.pick_variations(e, "test_mini_mini").withColumn("set", F.lit("test_mini_mini")),
             T.pick_variations(e, "train").withColumn("set", F.lit("train"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("set", "task_no", "variation_id")


query("topk_variation_policy", with_views(f"""
select 'test' as set, task_no, variation_id from e where fold = 'test'
  qualify row_number() over (partition by task_no order by {_md5_sql('variation_id')}, variation_id) <= 2
union all
select 'dev', task_no, variation_id from e where fold = 'dev' qualify row_number() over (partition by task_no order by variation_id) <= 3
union all
select 'test_mini_2', task_no, variation_id from e where fold = 'test'
  qualify row_number() over (partition by task_no order by variation_id) between 4 and 10
union all
select 'test_mini', task_no, variation_id from e where fold = 'test' qualify row_number() over (partition by task_no order by variation_id) <= 3
union all
select 'test_mini_mini', task_no, variation_id from e where fold = 'test' qualify row_number() over (partition by task_no order by variation_id) <= 1
union all
select 'train', task_no, variation_id from e where fold = 'train'
  qualify row_number() over (partition by task_no order by variation_id) - 1 <
          case when task_no = 26 then floor(count(*) over (partition by task_no) / 10)
               when task_no = 29 then floor(count(*) over (partition by task_no) / 2) else 1e9 end""",
    "e as (select distinct task_no, variation_id, fold from v_steps)"))(q_variation_policy)

query("topk_distinct_variations", with_views("""
select task_no, variation_id, step from v_f where variation_id in (
  select variation_id from (select distinct task_no, variation_id from v_f)
  qualify row_number() over (partition by task_no order by variation_id) <= 3)"""))(
    lambda spark, sf: T.first_variations(v_f_plain(spark, sf), 3).select("task_no", "variation_id", "step"))

query("topk_head", with_views("select variation_id, step, action from v_f order by task_no, variation_id, step limit 100"))(
    lambda spark, sf: T.head(v_f_plain(spark, sf), 100).select("variation_id", "step", "action"))

query("topk_exemplars", with_views("""
select task_no, variation_id, string_agg(concat(action, ', '), '' order by step) as path, count(*) over (partition by task_no) as n_found
from v_f where variation_id in (select variation_id from (select distinct task_no, variation_id from v_f)
                                qualify row_number() over (partition by task_no order by variation_id) <= 2)
group by task_no, variation_id"""))(
    lambda spark, sf: T.exemplars(W.min_steps(v_f_plain(spark, sf), 2), 2).select("task_no", "variation_id", "path", "n_found"))


def q_random_subgoal(spark, sf):
    f = v_f_plain(spark, sf)
    return T.inject_random(f, A.subgoal_vocab(f), 10, 1, ["variation_id"]).select("variation_id", "step", "subgoal")


query("topk_random_subgoal", with_views("""
select f.variation_id, f.step, coalesce(v.subgoal, f.subgoal) as subgoal from v_f f
left join (select subgoal, row_number() over (order by md5(subgoal), subgoal) - 1 as r from (select distinct subgoal from v_f)) v
  on f.step % 10 = 0 and v.r = (('0x' || substr(md5(concat_ws('|', '1', cast(f.variation_id as varchar), cast(f.step as varchar))), 1, 8))::bigint
                                % (select count(distinct subgoal) from v_f))"""))(q_random_subgoal)

# ============================================================== sets (U)

query("set_union_splits", with_views("select fold, variation_id, step from v_f where step >= 1 and fold in ('train', 'dev', 'test')"))(
    lambda spark, sf: (lambda ex: FL.by_fold(ex, "train").unionByName(FL.by_fold(ex, "dev")).unionByName(FL.by_fold(ex, "test")))(
        _examples(spark, sf)).select("fold", "variation_id", "step"))

ROOM_LIST_SQL = "['hallway', 'greenhouse', 'green house', 'kitchen', 'bathroom', 'outside', 'workshop', 'art studio', 'foundry', 'bedroom', 'living room']"

query("set_valid_actions", with_views(f"""
select variation_id, grp, action from cands
union
select variation_id, grp, concat('open door to ', unnest({ROOM_LIST_SQL})) from (select distinct variation_id, grp from cands)""",
    FOCUS_CANDS_SQL))(
    lambda spark, sf: extend_valid(v_cands(spark, sf), spark, ["variation_id", "grp"]))


def _focus_variants(spark, sf):
    c = v_cands(spark, sf)
    return c.withColumn("action", F.regexp_replace(F.regexp_replace("action", "^examine ", "focus on "), "^go to ", "focus on "))


query("set_invalid_focus", with_views(f"""
select variation_id, grp, action from (select variation_id, grp, regexp_replace(regexp_replace(action, '^examine ', 'focus on '), '^go to ', 'focus on ') as action from cands)
where not list_contains(list_transform(['agent', 'air'] || {ROOM_LIST_SQL}, lambda x: 'focus on ' || x), action)""", FOCUS_CANDS_SQL))(
    lambda spark, sf: drop_invalid_focus(_focus_variants(spark, sf)).select("variation_id", "grp", "action"))

