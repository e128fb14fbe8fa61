"""Registered queries: sources and sinks (round trips through the shared
scratch folder), streaming (R1-R3), history prompts (C13, C15) and the
dataset recipes (C16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.prompts import candidate_prompt, next_actions_prompt, plan_prompt
from ..operators import sampling as T
from ..operators import windows as W
from ..operators.compose import RECIPES, compose
from ..operators.datasets import RECIPE_NAMES, write_dataset
from ..sources import files as S
from ..sources import sinks as K
from ..sources.tables import table, task_dimension
from ..streaming import state as R
from .catalog import query
from .q_compose import FIRST_SQL, compose_sql
from .q_core import (DS_RULES, EPS_REAL_SQL, FINALS_SQL, HIST_STATE, LOOP_K, ROOMS_CTE, STEP_LIMIT, TEST_CAP, _demos, _md5_sql,
                     objects_sql)
from .sqlviews import _q, formalize_sql, strip_sql, with_views, with_views_rec
from .views import v_cands, v_f, v_f_plain, v_preds, v_steps, with_tasks

# ============================================================== S1 gold corpus


def gold_json(spark, sf):
    """The step table written in the gold-corpus shape,
    ``{task_id: {taskName, taskIdx, goldActionSequences: [...]}}``."""
    s = with_tasks(v_steps(spark, sf), spark)
    step = F.struct("action", "observation", F.col("score").cast("string").alias("score"),
                    F.lit("false").alias("isCompleted"), "freelook", "inventory")
    eps = s.groupBy("task_no", "task_name", "variation_id", "fold", "task_desc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", step.alias("s")))), lambda x: x["s"]).alias("path"))
    ep = F.struct(F.col("task_desc").alias("taskDescription"), F.col("variation_id").alias("variationIdx"),
                  "fold", "path")
    # one corpus object per episode (a task's episodes spread over many
    # objects/files; the reader merges them), so no task is gathered in one row
    obj = F.create_map(F.col("task_no").cast("string"),
                       F.struct(F.col("task_name").alias("taskName"), F.col("task_no").cast("string").alias("taskIdx"),
                                F.array(ep).alias("goldActionSequences")))
    return eps.select("task_no", "variation_id", F.to_json(obj).alias("value"))


def q_src_gold(spark, sf):
    d = K.scratch_dir(spark, "gold")
    # one JSON object per line (splittable); the reader merges the objects
    gold_json(spark, sf).select("value").write.text(d)
    g = S.read_gold(spark, d, one_object_per_file=False)
    return g.select(F.col("task_id").cast("long").alias("task_no"), "variation_id", "fold", "pos", "action", "score")


query("src_gold", with_views("select task_no, variation_id, fold, pos, action, score from v_steps"))(q_src_gold)



def q_src_gold_ranges(spark, sf):
    d = K.scratch_dir(spark, "gold-ranges")
    gold_json(spark, sf).select("value").write.text(d)
    g = S.read_gold_ranges(spark, d)
    return g.select(F.col("task_id").cast("long").alias("task_no"), "variation_id", "fold", "pos", "action", "score")


query("src_gold_ranges", with_views("select task_no, variation_id, fold, pos, action, score from v_steps"))(q_src_gold_ranges)

# ============================================================== K1 / S2 / S3 examples


def _examples(spark, sf):
    ex = compose(v_f(spark, sf), RECIPES["action_raw_norooms"])
    dim = task_dimension(spark).select("task_no", "task_real_id", "task_group")
    return ex.join(F.broadcast(dim), "task_no").select(
        "input", "target", F.col("task_no").cast("int").alias("task_id"), "variation_id", "task_real_id", "task_group",
        "fold", "step")


COMPOSED_SQL = EXAMPLES_SQL = compose_sql(RECIPES["action_raw_norooms"])

#: Sum of a 32-bit hash of every example's text: equal contents, not only equal counts.
CONTENT_SQL = "sum(('0x' || substr(md5(concat_ws('|', input, target)), 1, 8))::bigint)::bigint as content"


def content():
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "input", "target")), 1, 8), 16, 10).cast("long")).alias("content")


def q_sink_examples(spark, sf):
    d = K.scratch_dir(spark, "examples")
    K.write_examples(_examples(spark, sf).drop("task_group"), d)
    back = spark.read.json(d)  # partition columns come back from the folder names
    return back.groupBy("fold", "task_real_id").agg(F.count(F.lit(1)).alias("n"), content())


query("sink_examples", with_views(f"select x.fold, t.task_real_id, count(*) as n, {CONTENT_SQL} "
                                  f"from ({COMPOSED_SQL}) x join tasks t on x.task_no = t.task_no group by 1, 2"))(q_sink_examples)


def q_src_examples(spark, sf):
    d = K.scratch_dir(spark, "examples-s2")
    _examples(spark, sf).select("input", "target", "task_id", "variation_id", "task_real_id", "fold") \
        .write.partitionBy("fold").json(d)
    return S.read_examples(spark, d).select("variation_id", "input", "target")


query("src_examples", "select variation_id, input, target from (" + EXAMPLES_SQL + ")")(q_src_examples)


def q_src_by_suffix(spark, sf):
    stage = K.scratch_dir(spark, "examples-stage")
    flat = K.scratch_dir(spark, "examples-flat")
    ex = _examples(spark, sf)
    val_mini = T.first_per_group(ex.where("fold = 'dev'"), ["task_real_id"], 3, ["variation_id", "step"]) \
        .withColumn("fold", F.lit("val.mini"))
    named = ex.withColumn("fold", F.when(F.col("fold") == "dev", F.lit("val")).otherwise(F.col("fold"))).unionByName(val_mini)
    # partition on copies so every line keeps its own task_real_id, as in the original files
    named.select("input", "target", "task_id", "variation_id", "task_real_id",
                 F.col("task_real_id").alias("_t"), F.col("fold").alias("_s")).write.partitionBy("_t", "_s").json(stage)
    K.rename_parts(spark, stage, flat, lambda p, n: f"{p['_s'].split('.')[0]}/{p['_t']}-{n:05d}.{p['_s']}.json")
    read = [S.read_split(spark, flat, s).withColumn("split", F.lit(s)) for s in ("train", "val", "test")]
    return reduce(lambda a, b: a.unionByName(b), read).groupBy("split", "task_real_id").agg(F.count(F.lit(1)).alias("n"), content())


query("src_by_suffix", with_views(
    "select case x.fold when 'dev' then 'val' else x.fold end as split, t.task_real_id, count(*) as n, " + CONTENT_SQL +
    f" from ({COMPOSED_SQL}) x join tasks t on x.task_no = t.task_no group by 1, 2"))(q_src_by_suffix)

# ============================================================== K2


def q_sink_by_group(spark, sf):
    d = K.scratch_dir(spark, "groups")
    K.write_groups(_examples(spark, sf).drop("task_real_id"), d, mini_n=20)
    back = spark.read.json(d)
    return back.groupBy(F.col("task_group").cast("string").alias("task_group"), F.col("fold").alias("split")) \
        .agg(F.count(F.lit(1)).alias("n"), content())


query("sink_by_group", with_views("""
select task_group, fold as split, count(*) as n, {c} from gx group by 1, 2
union all
select task_group, 'dev.mini' as split, count(*) as n, {c} from (
  select * from gx where fold = 'dev' qualify row_number() over (partition by task_group order by task_no, variation_id, step) <= 20) group by 1""".replace("{c}", CONTENT_SQL),
    f"gx as (select x.*, split_part(t.task_real_id, '-', 1) as task_group from ({COMPOSED_SQL}) x join tasks t on x.task_no = t.task_no)"))(q_sink_by_group)

# ============================================================== S4 / K3 annotation cache


def _cache_rows(spark, sf):
    from .q_match import v_answers
    a = v_answers(spark, sf)
    f = v_f_plain(spark, sf)
    sg = f.groupBy("task_no", "variation_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "subgoal", "action"))),
                    lambda x: F.struct(x["action"].alias("action"), x["subgoal"].alias("sg"), x["step"].alias("idx"))).alias("pas"))
    return sg.join(a, "variation_id").select("task_no", "variation_id", F.lit("primary").alias("model"),
                                             F.col("answer").alias("chatgpt_output"), "pas")


def q_src_annotation_cache(spark, sf):
    d = K.scratch_dir(spark, "cache-csv")
    c = _cache_rows(spark, sf)
    # legacy form: nested columns written as python literals (single quotes)
    lit_list = F.concat(F.lit("["), F.array_join(F.transform(F.array_distinct(F.transform("pas", lambda x: x["sg"])),
                                                             lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))
    lit_pas = F.concat(F.lit("["), F.array_join(F.transform("pas", lambda x: F.format_string(
        "{'action': '%s', 'sg': '%s', 'idx': %d}", x["action"], x["sg"], x["idx"])), ", "), F.lit("]"))
    c.select(F.col("variation_id").alias("variations"), "chatgpt_output", lit_list.alias("subgoal"),
             lit_pas.alias("path_act_sg")).write.option("header", "true").option("escape", '"').csv(d)
    back = S.read_annotations(spark, d, legacy_csv=True)
    return back.select(F.col("variations").alias("variation_id"), F.size("subgoal").cast("long").alias("n_subgoals"),
                       F.size("path_act_sg").cast("long").alias("n_steps"),
                       F.aggregate(F.transform("path_act_sg", lambda x: x["idx"]), F.lit(0).cast("long"),
                                   lambda s, v: s + v).alias("idx_sum"))


query("src_annotation_cache", with_views(
    "select variation_id, count(distinct subgoal) as n_subgoals, count(*) as n_steps, sum(step)::bigint as idx_sum from v_f group by 1"))(
    q_src_annotation_cache)


def q_sink_annotation_append(spark, sf):
    d = K.scratch_dir(spark, "cache-append")
    c = _cache_rows(spark, sf)
    K.append_annotations(spark, c.where("variation_id % 2 = 0"), d)
    K.append_annotations(spark, c, d)          # overlaps the first write: only new keys are appended
    K.append_annotations(spark, c, d)          # idempotent
    back = spark.read.parquet(d)
    return back.groupBy("variation_id").agg(F.count(F.lit(1)).alias("copies"))


query("sink_annotation_append", with_views("select distinct variation_id, 1::bigint as copies from v_f"))(q_sink_annotation_append)

# ============================================================== S5 / S6


def q_src_messages(spark, sf):
    d = K.scratch_dir(spark, "messages")
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("text", "content")
    c.repartition(F.xxhash64("turn")).write.json(d)   # file order is scrambled on purpose
    m = S.read_messages(spark, d)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return m.select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev_role"))


query("src_messages", with_views(
    "select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as prev_role from conversations"))(q_src_messages)


def q_src_prompt_bank(spark, sf):
    f = v_f(spark, sf)
    bank = f.select(F.col("task_no").alias("taskIdx"), F.col("task_desc").alias("taskDescription"),
                    F.col("freelook").alias("look_around"), "inventory", "subgoal",
                    (F.col("variation_id") * 1000 + F.col("step")).alias("bank_pos"))
    tasks = table(spark, sf, "events", "user_id").select((F.col("user_id") % 32).alias("taskIdx")).distinct()
    out = S.prompt_for_task(bank, tasks)
    return out.select("taskIdx", "inventory", "subgoal")


query("src_prompt_bank", with_views("""
select t.taskIdx, b.inventory, b.subgoal from (select distinct user_id % 32 as taskIdx from events) t
left join (select task_no as taskIdx, arg_max(inventory, variation_id * 1000 + step) as inventory,
                  arg_max(subgoal, variation_id * 1000 + step) as subgoal from v_ft group by 1) b on b.taskIdx = t.taskIdx"""))(
    q_src_prompt_bank)

# ============================================================== K4 / K5 / K6


def q_sink_metrics(spark, sf):
    d = K.scratch_dir(spark, "metrics")
    from ..operators import aggregates as A
    from .views import v_pairs
    em = A.exact_match(v_pairs(spark, sf)).select("task_no", F.lit("exact_match").alias("metric"),
                                                  F.col("exact_match").alias("value"))
    K.write_metrics(em, d, "run-a")
    K.write_metrics(em.withColumn("value", F.col("value") / 2), d, "run-b")
    back = spark.read.parquet(d)
    return back.select("run_id", "task_no", "metric", F.round("value", 6).alias("value"))


query("sink_metrics", with_views("""
select 'run-a' as run_id, task_no, 'exact_match' as metric, round(avg(case when prediction = target then 1.0 else 0.0 end) * 100, 6) as value from pairs group by 2
union all
select 'run-b', task_no, 'exact_match', round(avg(case when prediction = target then 1.0 else 0.0 end) * 100 / 2, 6) from pairs group by 2""",
    """
pairs as (select task_no, variation_id, step, action as prediction, lead(action) over (partition by variation_id order by step) as target
          from v_f qualify target is not null)"""))(q_sink_metrics)


def q_sink_predictions(spark, sf):
    d = K.scratch_dir(spark, "preds")
    p = v_preds(spark, sf).where("rnk = 1").select("variation_id", "grp", F.concat(F.lit("  "), F.col("action"), F.lit(" ")).alias("prediction"))
    K.write_predictions(p, d, order=["variation_id", "grp"])
    return K.read_lines(spark, d).select("line", F.col("value").alias("prediction"))


query("sink_predictions", with_views(
    "select row_number() over (order by variation_id, step) - 1 as line, action as prediction from v_f where step % 5 = 0"))(q_sink_predictions)


def q_sink_run_history(spark, sf):
    d = K.scratch_dir(spark, "history")
    h = W.with_history_state(v_f_plain(spark, sf)).select("variation_id", "step", "h_action", "reward")
    K.write_history(h, d, max_rows=500)
    back = spark.read.parquet(d).withColumn("_file", F.col("_metadata.file_name"))
    per_file = back.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    # one row per episode read back; bounded = every file it landed in holds <= 500 rows
    j = back.join(per_file, "_file")
    return j.groupBy("variation_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("_n") <= 500).alias("bounded"))


query("sink_run_history", with_views("select variation_id, count(*) as rows, true as bounded from v_f group by 1"))(q_sink_run_history)

# ============================================================== C13 / C15 history prompts


PROMPT_K, PLAN_K = 10, 15


def situation_sql() -> str:
    """``sit``: what the prompts say of each episode's present (see ``prompts.situation``)."""
    from .q_core import FAILED_SQL
    from .q_match import ROOMS_SQL, _clean_look_sql
    lines = {k: _q(v) for k, v in fixed.PROMPT_LINES.items()}
    strip = strip_sql("replace(x, 'the ', ' ')")
    return f"""
located as (select *, list_filter({ROOMS_SQL}, lambda r: contains(split_part(freelook, '.', 1), 'called the ' || r))[1] as loc, {FAILED_SQL} as bad from v_ft),
ending as (select variation_id, task_no, task_desc, loc, freelook, inventory from located qualify row_number() over (partition by variation_id order by step desc) = 1),
failures as (select variation_id, string_agg(observation, chr(10) order by observation) as texts from (select distinct variation_id, observation from located where bad) group by 1),
focus0 as (select variation_id, action, min(step) as came from located where starts_with(action, 'focus on') and not bad group by 1, 2),
focus1 as (select variation_id, string_agg(replace(action, 'focus on', ''), ', ' order by came) as things from focus0 group by 1),
rooms0 as (select variation_id, loc, min(step) as came, arg_max(freelook, step) as look from located where loc is not null group by 1, 2),
rooms1 as (select r.variation_id, string_agg(concat('In ', r.loc, ': ', {_clean_look_sql('r.look', True)}), chr(10) order by r.came) as looks
           from rooms0 r join ending e using (variation_id) where r.loc is distinct from e.loc group by 1),
demos as (select f.task_no, string_agg(coalesce({formalize_sql('f.action')}, 'None'), chr(10) order by f.step) as demo
          from v_f f join (select task_no, min(variation_id) as variation_id from v_f group by 1) m
            on f.task_no = m.task_no and f.variation_id = m.variation_id group by 1),
sit as (select e.variation_id, d.demo, replace(e.task_desc, 'Your', 'my') as task, {_clean_look_sql('e.freelook', False)} as look, e.inventory, r.looks,
               case when p.things is null then {lines['not_focused']} else concat({lines['focused']}, p.things) end as focus,
               case when m.texts is not null then concat({lines['messages']}, chr(10), m.texts) end as messages,
               array_to_string(list_transform(regexp_extract_all(e.task_desc, 'focus on\\s+(\\w+(?:\\s+\\w+)*)', 1), lambda x: {strip}), ', ') as targets
        from ending e left join demos d on d.task_no = e.task_no left join failures m on m.variation_id = e.variation_id
        left join focus1 p on p.variation_id = e.variation_id left join rooms1 r on r.variation_id = e.variation_id)"""


HISTORY_SQL = f"""
hist0 as (select l.variation_id, l.step, l.loc, d.demo, case when starts_with(l.action, 'go to') then replace(l.action, 'go', 'teleport') else l.action end as a,
                 case when starts_with(l.action, 'go to') then replace(l.observation, 'go', 'teleport') else l.observation end as o
          from located l join demos d using (task_no) where not starts_with(l.action, 'examine')),
hist1 as (select *, coalesce({formalize_sql('a')}, 'None') as formal, lead(a) over w is not null
                    and coalesce(list_contains(list(a) over (partition by variation_id order by step rows between 5 preceding and 1 preceding), a), false)
                    and coalesce(list_contains(list(a) over (partition by variation_id order by step rows between 1 following and 4 following), a), false) as gone
          from hist0 where not starts_with(a, 'open door') window w as (partition by variation_id order by step)),
hist2 as (select *, sum(gone::int) over (partition by variation_id order by step) as upto from hist1
          where o <> 'N/A' and instr(formal, '(') > 0 and contains(demo, split_part(formal, '(', 1))),
hist3 as (select *, upto - coalesce(lag(upto) over (partition by variation_id order by step), 0) as times from hist2 where not gone),
hist4 as (select variation_id, step, unnest(case when times > 0 then [line, concat('Repeat the above action for ', times::bigint::varchar, ' times.')] else [line] end) as line,
                 unnest(case when times > 0 then [1, 2] else [1] end) as part
          from (select *, concat('- (in ', coalesce(loc, 'None'), ') Action: ', formal, ' --> ', o) as line from hist3)),
hist as (select variation_id, string_agg(line, chr(10) order by step, part) as history from (
  select * from hist4 qualify row_number() over (partition by variation_id order by step desc, part desc) <= {PROMPT_K}) group by 1)"""


def _next_sql() -> str:
    lines = {k: _q(v) for k, v in fixed.PROMPT_LINES.items()}
    return with_views(f"""
select s.variation_id, concat_ws(chr(10), concat({lines['example_next']}, s.demo), concat({lines['task_next']}, s.task),
  {_q(fixed.PROMPT_LINES['history'].format(PROMPT_K))}, h.history, s.focus, s.messages,
  concat({lines['environment']}, s.look, chr(10), s.inventory), concat({lines['targets_next']}, s.targets, ' . ')) as prompt
from sit s left join hist h using (variation_id)""", situation_sql(), HISTORY_SQL)


query("prompt_next_actions", _next_sql())(
    lambda spark, sf: next_actions_prompt(v_f(spark, sf), _demos(spark, sf), PROMPT_K).select("variation_id", "prompt"))


def q_prompt_select(spark, sf):
    f = v_f_plain(spark, sf).select("variation_id", "step", "freelook", "inventory", F.col("subgoal").alias("goal"))
    p = v_preds(spark, sf).where("rnk = 1").select("variation_id", "grp", "action")
    ctx = p.join(f, (p.variation_id == f.variation_id) & (f.step == p.grp * 5)).drop(f.variation_id)
    return candidate_prompt(v_cands(spark, sf), ctx, ["variation_id", "grp"])



def _select_sql():
    from .q_core import FOCUS_CANDS_SQL
    from .q_match import _clean_look_sql
    goal = ("concat(chr(10), ' I want to achieve this goal: ', f.subgoal, ' but my action ', chr(39), p.action, chr(39), "
            "' is not in the candidate list.')")
    return with_views(f"""
select p.variation_id, p.grp, concat_ws(chr(10), {_q(fixed.SELECT_INTRO)}, {_clean_look_sql('f.freelook', False)}, f.inventory,
    {_q(fixed.SELECT_LIST)}, l.lst, {goal}, {_q(fixed.SELECT_ASK)}, 'Selected action:') as prompt
from preds p join v_f f on f.variation_id = p.variation_id and f.step = p.grp * 5
join (select variation_id, grp, string_agg('- ' || action, chr(10) order by action) as lst
      from (select distinct variation_id, grp, action from cands) group by 1, 2) l on l.variation_id = p.variation_id and l.grp = p.grp
where p.rnk = 1""", FOCUS_CANDS_SQL)


query("prompt_select_candidate", _select_sql())(q_prompt_select)



def _observations_sql(lite: bool) -> str:
    """``seen_lite`` / ``seen_full``: the observation list of C14."""
    v = "lite" if lite else "full"
    moved = "(starts_with(observation, 'You move to the') or starts_with(observation, 'You go to the') or starts_with(observation, 'You teleport to the'))"
    again = "where first is null or step <= first" if lite else ""
    other = "concat('In ', place, ', ', o)" if lite else "concat('In ', place, ', ', action, ' --> ', o)"
    return f"""
{v}0 as (select variation_id, step, action, coalesce(loc, 'None') as place,
             case when {moved} then replace(replace(observation, 'go to', 'move to'), 'teleport to', 'move to') else observation end as o,
             coalesce(list_contains(list(action) over (partition by variation_id order by step rows between 5 preceding and 1 preceding), action), false)
               and coalesce(list_contains(list(action) over (partition by variation_id order by step rows between 1 following and 5 following), action), false) as rep
         from located),
{v}1 as (select *, contains(o, 'move to the') as move, min(case when not rep and not contains(o, 'move to the') then step end) over (partition by variation_id, place, o) as first
         from {v}0 where o <> 'The door is already open.'),
{v}2 as (select *, case when move then o else {other} end as line, sum(rep::int) over (partition by variation_id order by step) as reps from {v}1
         {again.replace('where first', 'where move or first')}),
{v}3 as (select *, reps - coalesce(lag(reps) over w, 0) as times, lead(line) over w as following_line from {v}2 where not rep window w as (partition by variation_id order by step)),
{v}4 as (select variation_id, step, unnest(case when times > 0 then [line, concat('Repeat the above ', times::bigint::varchar, ' times.')]
                                              when contains(line, 'move to the') and coalesce(contains(following_line, 'move to the'), false) then [] else [line] end) as line,
                unnest(case when times > 0 then [1, 2] when contains(line, 'move to the') and coalesce(contains(following_line, 'move to the'), false) then [] else [1] end) as part
         from {v}3),
{v}5 as (select variation_id, concat('- ', row_number() over w, '. ', replace(line, 'a substance called', 'there is a')) as line, row_number() over w as n
         from {v}4 window w as (partition by variation_id order by step, part)),
seen_{v} as (select variation_id, string_agg(line, chr(10) order by n) as observations from (
  select *, max(n) over (partition by variation_id) as total from {v}5) {f'where n > total - {PLAN_K}' if lite else ''} group by 1)"""


def _plan_sql() -> str:
    lines = {k: _q(v) for k, v in fixed.PROMPT_LINES.items()}

    def one(v, visited):
        return f"""select s.variation_id, '{v}' as form, concat_ws(chr(10), concat({lines['example_plan']}, s.demo), concat({lines['task_plan']}, s.task),
  {lines['observations']}, o.observations, {visited} concat({lines['here']}, s.look), replace(s.inventory, 'Your ', 'My '), s.focus, s.messages,
  concat({lines['targets_plan']}, s.targets, '!')) as prompt from sit s left join seen_{v} o using (variation_id)"""
    looks = f"case when s.looks is not null then concat({lines['visited']}, chr(10), s.looks) end,"
    return with_views(one("lite", "") + "\nunion all\n" + one("full", looks), situation_sql(), _observations_sql(True), _observations_sql(False))


def q_prompt_plan(spark, sf):
    steps, demos = v_f(spark, sf), _demos(spark, sf)
    forms = [plan_prompt(steps, demos, lite, PLAN_K).select("variation_id", F.lit(form).alias("form"), "prompt") for form, lite in (("lite", True), ("full", False))]
    return forms[0].unionByName(forms[1])


query("prompt_plan", _plan_sql())(q_prompt_plan)

# ============================================================== C16 dataset recipes


def q_recipes(spark, sf):
    d = K.scratch_dir(spark, "dataset")
    write_dataset(spark, v_f(spark, sf), d, rules=DS_RULES, min_len=SHORT, test_cap=TEST_CAP)
    read = [spark.read.json(f"{d}/{r}").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), content()).withColumn("recipe", F.lit(r)) for r in RECIPE_NAMES]
    return reduce(lambda a, b: a.unionByName(b), read).select("recipe", "fold", "n", "content")


SHORT = 45
query("dataset_recipes", with_views(" union all ".join(
    f"select '{r}' as recipe, x.fold, count(*) as n, {CONTENT_SQL} from ({FIRST_SQL if r == 'first_subgoal' else compose_sql(RECIPES[r])}) x "
    f"where x.variation_id in (select variation_id from chosen) group by 2" for r in RECIPE_NAMES), EPS_REAL_SQL, f"""
ds as (select * from (
  select *, row_number() over (partition by task_real_id order by {_md5_sql('variation_id')}, variation_id) as rn,
         case when starts_with(task_real_id, '9-') then 2 when starts_with(task_real_id, '10-') then 2
              when starts_with(task_real_id, '3-3') then 3 end as cap from eps_real) where cap is null or rn <= cap),
longer as (select d.* from ds d join (select variation_id, count(*) as n from v_f group by 1) c using (variation_id) where c.n >= {SHORT}),
chosen as (select * from (select *, sum(case when fold = 'test' then 1 else 0 end) over (partition by task_no order by variation_id rows between unbounded preceding and current row) as tests
           from longer) where tests < {TEST_CAP})"""))(q_recipes)

# ============================================================== R1-R3 streaming


STREAM_DELAY = "1 hour"          # disorder that the stream allows for
STREAM_GAP = "40 days"           # quiet time that closes an episode
STREAM_FILES = 4
STREAM_BEATS = 2                 # heartbeats, a file each, behind the log
STREAM_OBJECTS = 20              # limit of the FIFO of objects


def _stream_input(spark, sf):
    """``events`` as a log of files, each of a stretch of time with its rows in any
    order, then two heartbeats past the quiet time, which close all episodes."""
    d = K.scratch_dir(spark, "events-stream")
    ev = table(spark, sf, "events")
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / ((last - first).total_seconds() * 1e6 / STREAM_FILES + 1)), F.lit(STREAM_FILES - 1))
    for i in range(STREAM_FILES):
        ev.where(part == i).repartition(F.xxhash64("event_id")).write.mode("append").parquet(d)
    for i in range(1, STREAM_BEATS + 1):
        beat = spark.range(1).select(F.lit(-i).cast("long").alias("event_id"), (F.lit(last) + F.expr(f"interval {40 * 24 + 2 * i} hours")).cast("timestamp").alias("ts"),
                                     F.lit(-1).cast("long").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 50}').alias("props"))
        beat.write.mode("append").parquet(d)
    return d


def _files_per_trigger(spark, log, beats=0):
    """Files of ``log`` that make one of ``STREAM_FILES`` triggers: more input is larger
    triggers, not more of them, each of which touches most episodes again."""
    return max(1, -(-(len(spark.read.parquet(log).inputFiles()) - beats) // STREAM_FILES))


def _stream_steps(spark, sf):
    d = _stream_input(spark, sf)
    return R.event_steps(R.read_event_stream(spark, d, _files_per_trigger(spark, d, STREAM_BEATS))), d


def _run_stream(spark, df, name, mode="append", log=None):
    out = K.scratch_dir(spark, name)
    with R.state_partitions(spark, log):
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
             .outputMode(mode).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out)


def q_stream_state(spark, sf):
    ev, log = _stream_steps(spark, sf)
    s = R.stream_state(ev, watermark=STREAM_DELAY, object_limit=STREAM_OBJECTS, gap=STREAM_GAP)
    return _run_stream(spark, s, "r1", log=log).where("variation_id >= 0").select(
        "task_no", "variation_id", "step", "action", F.round("reward", 6).alias("reward"), "places", "objects")


query("stream_episode_state", with_views_rec(
    "select h2.task_no, variation_id, step, h2.action, round(h2.reward, 6) as reward, pl.places, array_to_string(st, ', ') as objects "
    "from h2 join rec using (variation_id, step) left join places pl using (variation_id, step)",
    HIST_STATE, ROOMS_CTE, objects_sql(STREAM_OBJECTS)))(q_stream_state)


def q_stream_stops(spark, sf):
    ev, log = _stream_steps(spark, sf)
    s = R.stream_state(ev, watermark=STREAM_DELAY, loop_k=LOOP_K, step_limit=STEP_LIMIT, gap=STREAM_GAP, mode="stops")
    return _run_stream(spark, s, "r2", log=log).where("variation_id >= 0").select(
        "variation_id", "task_no", "end_step", F.round("final_score", 6).alias("final_score"), "reason")


query("stream_stop_rules", with_views(
    f"""select variation_id, task_no, end_step, round(case when neg_step = end_step then 0.0 else score end, 6) as final_score,
  case when neg = step then 'negative'
       when step + 2 >= {LOOP_K} and len(list_distinct(case when step = {LOOP_K - 2} then list_prepend('look around', l) else l end)) = 2 then 'loop'
       when step = 2 * {STEP_LIMIT} - 1 then 'step_cap' else 'end' end as reason
from fin1 where step = end_step""", FINALS_SQL))(q_stream_stops)


def q_stream_scores(spark, sf):
    stops = q_stream_stops(spark, sf)
    # R3 consumes the R2 sink as a stream and keeps the running per-task mean
    src = K.scratch_dir(spark, "r3-in")
    stops.write.parquet(src)
    st = spark.readStream.schema(stops.schema).option("maxFilesPerTrigger", _files_per_trigger(spark, src)).parquet(src)
    out = K.scratch_dir(spark, "r3-metrics")
    with R.state_partitions(spark, src):
        q = (R.stream_scores(st).writeStream.outputMode("update").foreachBatch(R.write_epoch(out))
             .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    latest = spark.read.parquet(out).groupBy("task_no").agg(F.max_by(F.struct("mean_score", "episodes"), "epoch").alias("m"))
    return latest.select("task_no", F.round("m.mean_score", 6).alias("mean_score"), "m.episodes")


query("stream_running_score", with_views(
    "select task_no, round(avg(final_score), 6) as mean_score, count(*) as episodes from finals group by 1", FINALS_SQL))(q_stream_scores)
