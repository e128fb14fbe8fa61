"""Registered composition queries (C1-C10) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compose import RECIPES, Recipe, compose, compose_first_subgoal, Q_FIRST
from .catalog import query
from .sqlviews import (drop_phrases_sql, formalize_sql, look_room_sql, obs_room_sql,
                       sanitize_sql, trunc100_sql, with_views)
from .views import v_f

# ---------------------------------------------------------------- SQL pieces

HIST_STATE = """
h as (
  select *, case when step = 0 then 'look around' else action end as h_action,
         case when step = 0 then 'N/A' else observation end as h_obs,
         case when step = 0 then 0.0 else score end as h_score
  from v_ft),
h2 as (
  select *, coalesce(h_score - lag(h_score) over w, 0.0) as reward,
         lag(h_score) over w as prev_score,
         lag(observation) over w as prev_obs,
         lead(subgoal, 1, 'complete_task()') over w as next_subgoal
  from h window w as (partition by variation_id order by step))"""


def hist_cte(k: int, formal: bool) -> str:
    act = f"coalesce({formalize_sql('p.h_action')}, 'None')" if formal else "p.h_action"
    return f"""
hist as (
  select c.variation_id, c.step,
         string_agg(concat(' <extra_id_', 10 - (p.step - greatest(c.step - {k}, 0)), '> ', {act},
                           ' (+', {trunc100_sql('p.reward')}, ') --> ', p.h_obs, ' | '), '' order by p.step) as history
  from h2 c join h2 p on c.variation_id = p.variation_id and p.step between c.step - {k} and c.step - 1
  group by c.variation_id, c.step)"""


ROOMS_CTE = f"""
ritems as (
  select variation_id, step, 0 as sub, {obs_room_sql('prev_obs')} as room from h2 where step >= 1
  union all
  select variation_id, step, 1 as sub, {look_room_sql('freelook')} as room from h2 where step >= 1),
rfirst as (
  select variation_id, room, min(step * 2 + sub) as ord from ritems where room is not null group by 1, 2),
places as (
  select c.variation_id, c.step, string_agg(r.room, ', ' order by r.ord) as places
  from h2 c join rfirst r on c.variation_id = r.variation_id and r.ord <= c.step * 2 + 1
  group by 1, 2)"""

# adjacent-distinct sub-goal runs: run start rows, numbered
SG_CTE = """
sgs as (
  select variation_id, step, subgoal,
         case when lag(subgoal) over (partition by variation_id order by step) is null
                or lag(subgoal) over (partition by variation_id order by step) <> subgoal then 1 else 0 end as is_start
  from h2),
sgrun as (
  select c.variation_id, c.step,
         count(*) as n_sg,
         string_agg(s.subgoal, ', ' order by s.step) as sg_all,
         list(s.subgoal order by s.step) as sg_list
  from h2 c join sgs s on c.variation_id = s.variation_id and s.step <= c.step and s.is_start = 1
  group by 1, 2)"""


def _sg_block_sql(kind: str) -> str | None:
    n = "g.n_sg"
    lst = "g.sg_list"

    def joined(upto: str) -> str:
        return f"array_to_string(list_slice({lst}, 1, {upto}), ', ')"

    if kind == "none":
        return None
    if kind == "current_last":
        return (f"concat(case when {n} > 1 then concat('. Completed subtasks are: ', {joined(n + ' - 1')}) "
                f"else '. No completed subtasks' end, '. The current subtask is ', {lst}[{n}])")
    if kind == "current_second_last":
        return (f"concat(case when {n} > 2 then concat('. Completed subtasks are: ', {joined(n + ' - 2')}) "
                f"else '. No completed subtasks' end, case when {n} > 1 then concat('. The current subtask is ', {lst}[{n} - 1]) else '' end)")
    if kind == "test_last":
        return (f"concat(case when {n} > 1 then concat('. Completed subtasks are: ', {joined(n + ' - 1')}) "
                f"else '. No completed subtasks' end, case when {n} > 0 then concat('. The current subtask is ', {lst}[{n}]) else '' end)")
    if kind == "v4_second_last":
        return (f"case when {n} >= 2 then concat(case when {n} > 1 then concat('. Completed subtasks are: ', {joined('greatest(' + n + ' - 2, 0)')}) "
                f"else '. No completed subtasks' end, '. The current subtask is ', {lst}[{n} - 1]) end")
    raise ValueError(kind)


def compose_sql(r: Recipe) -> str:
    ctes = [HIST_STATE, hist_cte(r.history, r.formal_history)]
    joins = "join hist on hist.variation_id = x.variation_id and hist.step = x.step"
    if r.rooms:
        ctes.append(ROOMS_CTE)
        joins += " left join places pl on pl.variation_id = x.variation_id and pl.step = x.step"
    if r.subgoals != "none":
        ctes.append(SG_CTE)
        joins += " join sgrun g on g.variation_id = x.variation_id and g.step = x.step"
    pieces = ["x.task_desc", "' </s> Time: '", "cast(x.step as varchar)", "'; Score: '",
              trunc100_sql("x.prev_score"), "'; </s> '"]
    block = _sg_block_sql(r.subgoals)
    if block:
        pieces.append(block)
    pieces += ["'Action history: </s>'", "hist.history", "' </s> '",
               "'Current environment: '", "x.freelook", "' </s> '",
               "'Current inventory: '", "x.inventory", "' </s> '"]
    if r.rooms:
        pieces.append("case when pl.places is not null then concat('Visited rooms: ', pl.places, ' </s> ') else '' end")
    pieces.append("'" + r.question + "'")
    text = drop_phrases_sql(sanitize_sql("concat(" + ", ".join(pieces) + ")"))
    if r.subgoals == "v4_second_last":  # fewer than 2 sub-goals: no input (the template fails there)
        text = f"(case when g.n_sg >= 2 then {text} end)"
    if r.label == "formal_action":
        target = formalize_sql(sanitize_sql("x.action"))
    elif r.label == "raw_action":
        target = sanitize_sql("x.action")
    else:
        target = "x.next_subgoal"
    body = (f"select x.task_no, x.variation_id, x.fold, x.step, {text} as input, {target} as target "
            f"from h2 x {joins} where x.step >= 1")
    return with_views(body, *ctes)


def _register(key: str, recipe_name: str) -> None:
    r = RECIPES[recipe_name]

    def build(spark, sf):
        return compose(v_f(spark, sf), r)

    query(key, compose_sql(r))(build)


for _key, _name in [
    ("compose_action_sg", "action_sg"),
    ("compose_subgoal", "subgoal"),
    ("compose_subgoal_eval", "subgoal_eval"),
    ("compose_subgoal_v4", "subgoal_v4"),
    ("compose_action_sg_nohist", "action_sg_nohist"),
    ("compose_action_formal", "action_formal"),
    ("compose_action_raw", "action_raw"),
    ("compose_action_raw_nohist", "action_raw_nohist"),
    ("compose_action_raw_norooms", "action_raw_norooms"),
]:
    _register(_key, _name)


FIRST_SQL = with_views(
    "select task_no, variation_id, fold, "
    + drop_phrases_sql(sanitize_sql(
        "concat(task_desc, ' </s> Time: 1; Score: 0; </s> ', 'Current environment: ', freelook, ' </s> ', "
        "'Current inventory: ', inventory, ' </s> ', '" + Q_FIRST + "')"))
    + " as input, subgoal as target from v_ft where step = 0")


@query("compose_first_subgoal", FIRST_SQL)
def q_first_subgoal(spark, sf):
    return compose_first_subgoal(v_f(spark, sf))
