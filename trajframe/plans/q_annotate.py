"""Registered queries: annotation parsing, alignment, repair, labelling and
the annotation prompts (L1-L7, C11, C12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import annotate as L
from ..operators import reports as RP
from ..operators import sampling as T
from ..operators import windows as W
from ..session import cut
from ..sources import sinks as K_
from .catalog import query
from .q_match import ANSWERS_SQL, v_answers
from .sqlviews import strip_sql, with_views, with_views_rec
from .views import v_f, v_f_plain

K = ["variation_id"]
#: What alignment and repair read of a step; its texts would only be carried along.
STEP = [*K, "step", "action", "_nb"]


def _items_sql(mark: bool) -> str:
    clean = strip_sql("regexp_replace(x, '[{,}.'']', '', 'g')")
    acts = ("list_filter(list_transform(string_split(regexp_extract(item, '\\{([^{}]*)\\}', 1), ','), "
            f"lambda x: {clean}), lambda x: x <> '')")
    if mark:
        acts = f"list_append({acts}, 'end subgoal')"
    return f"""
it as (select variation_id, unnest(items) as item, generate_subscripts(items, 1) as ipos
       from (select variation_id, regexp_extract_all(answer, '(?:^|\\s)\\d+-\\s*[^{{}}]*?:\\s*\\{{[^{{}}]*\\}}', 0) as items from answers)),
it2 as (select variation_id, ipos, cast(regexp_extract(item, '(\\d+)-', 1) as int) as sg_no,
               {strip_sql("regexp_extract(item, '\\d+-\\s*([^{}]*?)\\s*:\\s*\\{', 1)")} as sg, {acts} as acts from it),
ex as (select variation_id, sg_no, sg, unnest(acts) as action, generate_subscripts(acts, 1) as act_no, ipos from it2),
ann_items as (select variation_id, sg_no, sg, act_no, action,
                     cast(row_number() over (partition by variation_id order by ipos, act_no) - 1 as int) as idx from ex)"""


query("explode_annotations", with_views("select variation_id, sg_no, sg, act_no, action, idx from ann_items",
                                        ANSWERS_SQL, _items_sql(False)))(
    lambda spark, sf: L.explode_annotations(v_answers(spark, sf), K).select(
        "variation_id", "sg_no", "sg", F.col("act_no").cast("long").alias("act_no"), "action", "idx"))

query("explode_annotations_marked", with_views("select variation_id, sg_no, sg, act_no, action, idx from ann_items",
                                               ANSWERS_SQL, _items_sql(True)))(
    lambda spark, sf: L.explode_annotations(v_answers(spark, sf), K, mark=True).select(
        "variation_id", "sg_no", "sg", F.col("act_no").cast("long").alias("act_no"), "action", "idx"))


def v_ann(spark, sf):
    """FIXTURES ``v_ann``: v_f with rows removed where k % 11 = 0 and ``wait1``
    inserted before rows where k % 13 = 0 (k = round(score*100) + 2)."""
    f = v_f_plain(spark, sf).withColumn("_k", (F.round(F.col("score") * 100) + 2).cast("int"))
    orig = f.where(F.col("_k") % 11 != 0).select("task_no", "variation_id", (F.col("step") * 2 + 1).alias("_o"), "action", "subgoal")
    ins = f.where(F.col("_k") % 13 == 0).select("task_no", "variation_id", (F.col("step") * 2).alias("_o"),
                                                F.lit("wait1").alias("action"), "subgoal")
    a = orig.unionByName(ins)
    w = Window.partitionBy("variation_id").orderBy("_o")
    return a.withColumn("step", (F.row_number().over(w) - 1).cast("int")).drop("_o")


V_ANN_SQL = """
ann0 as (select variation_id, step * 2 + 1 as o, action, subgoal from v_f where (cast(round(score * 100) as int) + 2) % 11 <> 0
         union all
         select variation_id, step * 2 as o, 'wait1' as action, subgoal from v_f where (cast(round(score * 100) as int) + 2) % 13 = 0),
v_ann as (select variation_id, cast(row_number() over (partition by variation_id order by o) - 1 as int) as step, action, subgoal from ann0)"""

#: Longest common subsequences from the ends, row by row, then the walk from the start
#: that adds as early as it can, then removes, else matches.
EDITS_SQL = """
long2 as (select g.variation_id, g.n - 1 as n, a.n - 1 as m from (select variation_id, count(*) as n from v_f group by 1) g
          join (select variation_id, count(*) as n from v_ann group by 1) a using (variation_id)),
lcs(variation_id, i, j, l) as (
  select variation_id, n, unnest(range(m + 1)), 0::bigint from long2
  union all
  select variation_id, i - 1, j, max(greatest(l, case when hit then after + 1 else 0 end)) over (partition by variation_id order by j desc) from (
    select t.variation_id, t.i, t.j, t.l, lead(t.l) over (partition by t.variation_id order by t.j) as after, coalesce(g.action = a.action and t.j < z.m, false) as hit
    from lcs t join long2 z on z.variation_id = t.variation_id join v_f g on g.variation_id = t.variation_id and g.step = t.i - 1
      left join v_ann a on a.variation_id = t.variation_id and a.step = t.j where t.i > 0)),
grid as (select *, lead(l) over (partition by variation_id, j order by i) as below, lead(l) over (partition by variation_id, i order by j) as beside from lcs),
moves as (select *, case when below is null and beside is null then null when beside is null then 'add' when below is null then 'remove'
                         when below = l then 'add' when beside = l then 'remove' else 'match' end as op from grid),
trail(variation_id, i, j, op) as (
  select variation_id, i, j, op from moves where i = 0 and j = 0
  union all
  select t.variation_id, m.i, m.j, m.op from trail t join moves m on m.variation_id = t.variation_id
    and m.i = t.i + (t.op <> 'remove')::int and m.j = t.j + (t.op <> 'add')::int where t.op is not null),
edits as (select variation_id, op, i, j from trail where op in ('add', 'remove'))"""

REPAIR_SQL = """
gold_rows as (select f.variation_id, f.step, f.action, e.j as aj, a.variation_id is null as bare, e.op is not null or a.variation_id is null as added
              from v_f f left join edits e on e.variation_id = f.variation_id and e.op = 'add' and e.i = f.step
              left join (select distinct variation_id from v_ann) a on a.variation_id = f.variation_id),
kept_rows as (select a.variation_id, a.subgoal, row_number() over (partition by a.variation_id order by a.step) as k from v_ann a
              where not exists (select 1 from edits e where e.variation_id = a.variation_id and e.op = 'remove' and e.j = a.step)),
ranked as (select *, case when not added then sum((not added)::int) over (partition by variation_id order by step) end as k,
                  step - row_number() over (partition by variation_id, added order by step) as island from gold_rows),
runs as (select *, count(*) over (partition by variation_id, added, island) as run, min(step) over (partition by variation_id, added, island) as first from ranked),
repaired as (select r.variation_id, r.step, r.action,
                    case when not r.added then k.subgoal when r.run = 1 and not r.bare then a.subgoal end as subgoal,
                    case when not r.added then 'matched' when r.run = 1 and not r.bare then 'inherited' else 'gap' end as source,
                    case when r.added and not (r.run = 1 and not r.bare) then r.first end as gap_start
             from runs r left join kept_rows k on k.variation_id = r.variation_id and k.k = r.k
             left join v_ann a on a.variation_id = r.variation_id and a.step = greatest(r.aj - 1, 0))"""


def q_align(spark, sf):
    return L.align(v_f_plain(spark, sf), v_ann(spark, sf), K)


query("align_trajectories", with_views_rec("""
select z.variation_id, (z.n + z.m - 2 * l.l)::int as distance, e.op, e.i::int as i, e.j::int as j
from long2 z join lcs l on l.variation_id = z.variation_id and l.i = 0 and l.j = 0 left join edits e on e.variation_id = z.variation_id""",
    V_ANN_SQL, EDITS_SQL))(q_align)


def _repaired(spark, sf):
    gold, ann = cut(v_f_plain(spark, sf).select(*STEP), "gold"), cut(v_ann(spark, sf), "annotation")
    return L.repair(cut(L.align(gold, ann, K), "edits"), gold, ann, K)


query("repair_annotations", with_views_rec(
    "select variation_id, step::bigint as step, action, subgoal, source, gap_start::bigint as gap_start from repaired",
    V_ANN_SQL, EDITS_SQL, REPAIR_SQL))(lambda spark, sf: _repaired(spark, sf))


def q_label(spark, sf):
    items = L.explode_annotations(v_answers(spark, sf), K)
    lab, _bad = L.label_steps(v_f_plain(spark, sf), items, K)
    return lab.select("variation_id", "step", "action", "subgoal")


query("label_steps", with_views("""
select f.variation_id, f.step, f.action, a.sg as subgoal from v_f f left join ann_items a on a.variation_id = f.variation_id and a.idx = f.step""",
    ANSWERS_SQL, _items_sql(False)))(q_label)


def q_label_violations(spark, sf):
    ann = v_ann(spark, sf).select("variation_id", F.col("step").alias("idx"), "action", F.col("subgoal").alias("sg"))
    _lab, bad = L.label_steps(v_f_plain(spark, sf), ann, K)
    return bad.groupBy("variation_id").agg(F.count(F.lit(1)).alias("violations"))


query("label_steps_violations", with_views("""
select f.variation_id, count(*) as violations from v_f f left join v_ann a on a.variation_id = f.variation_id and a.step = f.step
where a.action is null or a.action <> f.action group by 1""", V_ANN_SQL))(q_label_violations)


def q_label_report(spark, sf):
    """L6 with its report: the counts of the running write, and its side table."""
    ann = v_ann(spark, sf).select("variation_id", F.col("step").alias("idx"), "action", F.col("subgoal").alias("sg"))
    d = K_.scratch_dir(spark, "checked")
    counts = RP.write_checked(RP.labelled_with_action(v_f_plain(spark, sf).drop("_nb"), ann, K), d, "labels", RP.label_faults())
    side = RP.rejected_rows(spark, d).groupBy("fault").agg(F.count(F.lit(1)).alias("rejected"))
    good = RP.accepted_rows(spark, d).agg(F.lit("none").alias("fault"), F.count(F.lit(1)).alias("rejected"))
    told = RP.summary(spark, {"labels": {("none" if k == "rows" else k): (v if k != "rows" else 2 * v - sum(counts.values())) for k, v in counts.items()}})
    return told.join(side.unionByName(good), "fault", "left").select("fault", "n", "rejected")


query("report_label_faults", with_views("""
select fault, count(*) as n, count(*) as rejected from (
  select case when a.action is null then 'no annotation' when a.action <> f.action then 'another action' else 'none' end as fault
  from v_f f left join v_ann a on a.variation_id = f.variation_id and a.step = f.step) group by 1""", V_ANN_SQL))(q_label_report)


def q_greedy(spark, sf):
    items = L.explode_annotations(v_answers(spark, sf), K)
    return L.greedy_align(v_f_plain(spark, sf), cut(items, "items"), K).select(
        "variation_id", F.col("pos").cast("long").alias("pos"), "gold_step", "action", "subgoal", "is_marker", "answer")


query("greedy_align", with_views_rec("""
select s.variation_id, s.gold_step + p.nth - 1 as pos, s.gold_step, trim(s.raw) as action, s.sg as subgoal, false as is_marker, w.answer
from hits s join parts p using (variation_id, sg_no, sg) join written w using (variation_id)
union all
select p.variation_id, p.last + p.nth, p.last, 'end subgoal', p.sg, true, w.answer from parts p join written w using (variation_id)""",
    ANSWERS_SQL, _items_sql(False), """
walked(variation_id, gold_step, idx) as (
  select distinct variation_id, -1::bigint, -1::bigint from ann_items
  union all
  select w.variation_id, w.gold_step + 1, min(o.idx)::bigint from walked w join v_f f on f.variation_id = w.variation_id and f.step = w.gold_step + 1
    join ann_items o on o.variation_id = w.variation_id and o.idx > w.idx and trim(o.action) = f.action group by w.variation_id, w.gold_step),
hits as (select w.variation_id, w.gold_step, o.sg_no, o.sg, o.action as raw from walked w join ann_items o using (variation_id, idx)),
parts as (select h.variation_id, h.sg_no, h.sg, max(h.gold_step) as last, string_agg(h.raw || ', ', '' order by h.gold_step) as acts,
                 row_number() over (partition by h.variation_id order by f.first, h.sg_no, h.sg) as nth
          from hits h join (select variation_id, sg_no, sg, min(idx) as first from ann_items group by 1, 2, 3) f using (variation_id, sg_no, sg)
          group by h.variation_id, h.sg_no, h.sg, f.first),
written as (select variation_id, string_agg(concat(nth, '- ', sg, ': {', acts, '}', chr(10)), '' order by nth) as answer from parts group by 1)"""))(q_greedy)


def v_ann_answers(spark, sf):
    """Answers written from the perturbed annotation ``v_ann`` (same format
    as ``v_answers``), so that alignment has work to do."""
    a = v_ann(spark, sf)
    w = Window.partitionBy("variation_id").orderBy("step")
    chg = F.when(F.lag("subgoal").over(w).isNull() | (F.lag("subgoal").over(w) != F.col("subgoal")), 1).otherwise(0)
    a = a.withColumn("run", F.sum(chg).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = a.groupBy("variation_id", "run").agg(
        F.first("subgoal").alias("sg"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))),
                                 lambda x: F.concat(F.lit("'"), x["action"], F.lit("'"))), ", ").alias("acts"))
    item = F.concat(F.col("run").cast("string"), F.lit("- "), F.col("sg"), F.lit(": {"), F.col("acts"), F.lit("} "))
    return runs.groupBy("variation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", item.alias("it")))), lambda x: x["it"]), "").alias("answer"))


def q_annotate(spark, sf):
    answers = v_ann_answers(spark, sf)
    cache = answers.where("variation_id % 3 = 0")

    def answer_fn(need):
        return need.join(answers, K, "inner")

    def gap_fn(gaps):
        acts = F.array_join(F.transform("missed", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
        return gaps.select(*K, "gap_start", F.concat(F.lit("1- fill("), F.col("gap_start").cast("string"), F.lit("): {"), acts, F.lit("} ")).alias("answer"))

    labelled, _fresh, _report = L.annotate(v_f_plain(spark, sf).select(*STEP, "observation"), cache, answer_fn, gap_fn, K)
    return labelled.select("variation_id", F.col("step").cast("long").alias("step"), "action", "subgoal", "source", "is_marker")


# the answers say what ``v_ann`` holds, so the annotation is ``v_ann`` and gaps are filled by name
query("annotate_batch", with_views_rec("""
select variation_id, step + before as step, action, subgoal, source, false as is_marker from marked
union all
select variation_id, step + before + 1, 'end subgoal', subgoal, source, true from marked where chg = 1""", V_ANN_SQL, EDITS_SQL, REPAIR_SQL, """
labelled as (select variation_id, step, action, case when source = 'gap' then concat('fill(', gap_start::bigint, ')') else subgoal end as subgoal, source from repaired),
changes as (select *, (lead(subgoal) over w is not null and lead(subgoal) over w <> subgoal)::int as chg from labelled window w as (partition by variation_id order by step)),
marked as (select *, coalesce(sum(chg) over (partition by variation_id order by step rows between unbounded preceding and 1 preceding), 0)::bigint as before from changes)"""))(
    q_annotate)


def _paths(spark, sf):
    f = W.min_steps(v_f(spark, sf), 2)
    return f.groupBy("task_no", "variation_id", "task_desc").agg(
        L.path_text(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))), lambda x: x["action"])).alias("path"))


def q_prompt_annotate(spark, sf):
    eps = _paths(spark, sf)
    ex = T.exemplars(W.min_steps(v_f_plain(spark, sf), 2), 1).join(v_answers(spark, sf), K).select("task_no", "path", "answer")
    p = L.annotation_prompt(eps, ex, K)
    return p.select("variation_id", F.size("messages").cast("long").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


query("prompt_annotate", with_views("""
select p.variation_id, 4 as n_messages,
       concat('system: You are a helpful assistant.', chr(10),
              'user: ', p.task_desc, 'Here is the goal path to achieve to the goal:', coalesce(x.path, ''), chr(10),
              'assistant: ', coalesce(x.answer, ''), chr(10),
              'user: ', p.task_desc, 'Here is the goal path to achieve to the goal:', p.path) as prompt
from paths p left join ex x on x.task_no = p.task_no""", ANSWERS_SQL, """
paths as (select task_no, variation_id, task_desc, string_agg(concat(action, ', '), '' order by step) as path from v_ft group by 1, 2, 3),
ex as (select p.task_no, p.path, a.answer from paths p join answers a on a.variation_id = p.variation_id
       where p.variation_id in (select min(variation_id) from v_f group by task_no))""").replace("4 as n_messages", "cast(4 as bigint) as n_messages"))(
    q_prompt_annotate)


def q_prompt_gap(spark, sf):
    gaps = L.gap_requests(_repaired(spark, sf), K)
    eps = _paths(spark, sf).join(v_ann_answers(spark, sf), K)
    p = L.gap_prompt(gaps, eps, K)
    return p.select("variation_id", "gap_start", F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("prompt"))


query("prompt_annotate_gap", with_views_rec("""
select g.variation_id, g.gap_start::bigint as gap_start, concat('You are a helpful assistant.', chr(10),
    p.task_desc, 'Here is the goal path to achieve to the goal:', p.path,
    '. Based on the given goal path, you already provided me with the functional format of high-level sub-tasks to complete this task and their correspondings actions.which are: ',
    w.answer, chr(10), '. Now, here is the goal path', g.missed,
    ' What is the functional format of high-level sub-task assigned to these actions? Tell them in numeric format.') as prompt
from (select variation_id, gap_start, concat('[', string_agg(concat(chr(39), action, chr(39)), ', ' order by step), ']') as missed
      from repaired where source = 'gap' group by 1, 2) g
join (select variation_id, task_desc, string_agg(concat(action, ', '), '' order by step) as path from v_ft group by 1, 2) p using (variation_id)
join said w using (variation_id)""", V_ANN_SQL, EDITS_SQL, REPAIR_SQL, """
ann_runs as (select *, sum(new) over (partition by variation_id order by step) as run from (
  select *, (lag(subgoal) over w is null or lag(subgoal) over w <> subgoal)::int as new from v_ann window w as (partition by variation_id order by step))),
said as (select variation_id, string_agg(item, '' order by run) as answer from (
  select variation_id, run, concat(run::bigint, '- ', any_value(subgoal), ': {', string_agg(concat(chr(39), action, chr(39)), ', ' order by step), '} ') as item
  from ann_runs group by 1, 2) group by 1)"""))(q_prompt_gap)
