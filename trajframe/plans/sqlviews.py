"""DuckDB oracle side: the same bindings as ``views.py`` written as SQL CTEs,
plus SQL text for the column builders.  Used only by ``oracle_sql()``."""

from __future__ import annotations

from ..functions.actions import formalize_sql, recover_sql  # noqa: F401  (re-export)
from ..functions.fixed import DROPPED_PHRASES, SANITIZE_PHRASES, TASK_TABLE

V_STEPS = """
v_steps as (
with b as (
  select user_id, event_id, ts, event_type, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events),
r as (
  select *, split_part('hallway,greenhouse,kitchen,bathroom,outside,workshop,art studio,foundry,bedroom,living room', ',', k % 10 + 1) as room,
         split_part('metal pot,orange,thermometer,glass cup,apple seed,picture,red wire', ',', k % 7 + 1) as obj
  from b)
select user_id as variation_id, user_id % 30 as task_no,
  case when cast(floor(user_id / 30) as int) % 5 in (1, 4) then 'test'
       when cast(floor(user_id / 30) as int) % 5 = 3 then 'dev' else 'train' end as fold,
  row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
  case event_type when 'view' then 'look around'
       when 'error' then case when k % 2 = 0 then concat('close door to ', room) else concat('eat ', obj) end
       when 'click' then case k % 3 when 0 then concat('go to ', room) when 1 then concat('teleport to ', room) else concat('open door to ', room) end
       when 'purchase' then case k % 3 when 0 then concat('pick up ', obj) when 1 then concat('examine ', obj) else 'wait1' end
       else concat('move ', obj, ' to ', room) end as action,
  case when event_type = 'click' then concat('You move to the ', room, '.')
       when event_type = 'error' then 'No known action matches that input.'
       else concat('You see the ', obj, '.') end as observation,
  cast((k - 2) / 100.0 as double) as score,
  concat('This room is called the ', room, '. In it, you see: ', chr(10), chr(9), 'the agent', chr(10), chr(9), 'a ', obj, ' (that is open)', chr(10), chr(9), 'a substance called air', chr(10), 'You also see:', chr(10), chr(9), 'A door to the ', room, chr(10)) as freelook,
  concat('In your inventory, you see: a ', obj) as inventory,
  concat('visit(', split_part('kitchen,workshop,outside', ',', cast(floor(k / 34) as int) + 1), ')') as subgoal
from r)"""

V_F_PLAIN = """
v_f as (
  select *, row_number() over (partition by variation_id order by pos) - 1 as step
  from v_steps where not (action = 'look around' or starts_with(action, 'close door')))"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


TASKS = ("tasks as (select * from (values " + ", ".join(
    f"({i}, {_q(n)}, {_q(r)}, {_q(r.split('-')[0])})" for i, (n, r) in enumerate(TASK_TABLE)
) + ") t(task_no, task_name, task_real_id, task_group))")

V_FT = """
v_ft as (
  select f.*, t.task_name, t.task_real_id, t.task_group,
         concat('Your task is to ', translate(t.task_name, '-', ' '), '.') as task_desc
  from v_f f left join tasks t on f.task_no = t.task_no)"""


def with_views(body: str, *ctes: str) -> str:
    """``WITH <ctes> <body>``; v_steps / v_f / tasks are always available."""
    base = [V_STEPS, V_F_PLAIN, TASKS, V_FT]
    return "with " + ",\n".join(base + list(ctes)) + "\n" + body


def with_views_rec(body: str, *ctes: str) -> str:
    """Same as ``with_views`` for bodies that use a recursive CTE."""
    return "with recursive " + with_views(body, *ctes)[len("with "):]


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sanitize_sql(x: str) -> str:
    out = f"replace(replace(replace({x}, chr(10) || chr(9), ' | '), chr(10), ' | '), chr(9), ' | ')"
    for a, b in SANITIZE_PHRASES:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


def drop_phrases_sql(x: str) -> str:
    out = x
    for p in DROPPED_PHRASES:
        out = f"replace({out}, {_q(p)}, '')"
    return out


def obs_room_sql(o: str) -> str:
    i = f"instr({o}, 'move to the')"
    n = f"(length({o}) - {i} - 12)"
    inner = f"(case when {n} > 0 then substr({o}, {i} + 12, {n}) else '' end)"
    return f"(case when {i} > 0 then {strip_sql(inner)} end)"


def look_room_sql(l: str) -> str:
    s = f"(instr({l}, 'This room is called the') - 1)"
    e = f"(case when instr({l}, '.') > 0 then instr({l}, '.') - 1 else length({l}) - 1 end)"
    n = f"({e} - ({s} + 24))"
    return f"(case when {s} >= 0 then (case when {n} > 0 then substr({l}, {s} + 25, {n}) else '' end) end)"


def trunc100_sql(x: str) -> str:
    return f"cast(trunc(({x}) * 100) as bigint)"
