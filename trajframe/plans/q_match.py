"""Registered queries: matching, scoring and the whole-table text jobs
(J2-J8, T6/T7, A8/A9, X1-X12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.actions import formal_verb, formalize, recover
from ..functions.text import (clean_look, current_room, focus_targets, object_mentions, py_strip, sanitize,
                              strip_generation, truncate_tokens)
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.compose import RECIPES, compose
from ..operators.sampling import seeded_int
from ..sources.tables import table
from .catalog import query
from .q_core import FOCUS_CANDS_SQL, PAIRS_SQL, ROOM_LIST_SQL, mentions_sql
from ..functions.hooks import library_tokenizer, truncate_by_tokenizer
from .sqlviews import formalize_sql, recover_sql, sanitize_sql, strip_sql, with_views
from .views import v_cands, v_eps, v_f, v_f_plain, v_pairs, v_preds, v_steps, v_vecs

GK = ["variation_id", "grp"]

# ============================================================== J4 / J5

query("join_prediction_valid", with_views(f"""
select p.variation_id, p.grp, arg_min(p.a, p.rnk) as action, min(p.rnk) as rank
from (select variation_id, grp, rnk, {strip_sql("replace(action, 'green house', 'greenhouse')")} as a from preds where rnk <= 5) p
join (select distinct variation_id, grp, action from cands) c on c.variation_id = p.variation_id and c.grp = p.grp and c.action = p.a
group by 1, 2""", FOCUS_CANDS_SQL))(
    lambda spark, sf: J.pick_valid(v_preds(spark, sf), v_cands(spark, sf), GK))


def q_token_overlap(spark, sf):
    preds, cands = v_preds(spark, sf), v_cands(spark, sf)
    hits = J.pick_valid(preds, cands, GK).select(*GK)
    rest = preds.join(cands.select(*GK).distinct(), GK, "left_semi").join(hits, GK, "left_anti")
    return J.nearest_by_tokens(rest, cands, GK)


query("join_token_overlap", with_views(f"""
select p1.variation_id, p1.grp, regexp_replace(coalesce(b.cand, p1.pred), '[^A-Za-z0-9 ]+', '', 'g') as action,
       coalesce(b.n, 0) as overlap
from p1 left join (select * from common qualify row_number() over (partition by variation_id, grp order by n desc, length(cand), cand) = 1) b
  using (variation_id, grp)""", FOCUS_CANDS_SQL, f"""
hits as (select distinct p.variation_id, p.grp from preds p join cands c on c.variation_id = p.variation_id and c.grp = p.grp
         and c.action = {strip_sql("replace(p.action, 'green house', 'greenhouse')")} where p.rnk <= 5),
p1 as (select variation_id, grp, action as pred from preds p where rnk = 1
       and exists (select 1 from cands c where c.variation_id = p.variation_id and c.grp = p.grp)
       and not exists (select 1 from hits h where h.variation_id = p.variation_id and h.grp = p.grp)),
pt as (select distinct variation_id, grp, unnest(string_split(pred, ' ')) as tok from p1),
ct as (select distinct variation_id, grp, cand, tok from (select variation_id, grp, action as cand, unnest(string_split(action, ' ')) as tok from cands)),
common as (select ct.variation_id, ct.grp, ct.cand, count(*) as n from ct join pt using (variation_id, grp, tok) group by 1, 2, 3)"""))(
    q_token_overlap)

# ============================================================== the whole chain


def _painted(c):
    return F.replace(F.replace(F.col(c), F.lit("metal pot"), F.lit("paint in bowl")), F.lit("orange"), F.lit("paint in jug"))


def q_resolve(spark, sf):
    from ..operators import windows as W
    from .views import over_chunks
    f = v_f(spark, sf)
    cands = v_cands(spark, sf).withColumn("action", F.regexp_replace(_painted("action"), "^examine ", "focus on "))
    preds = v_preds(spark, sf).join(cands.select(*GK).distinct(), GK, "left_semi").withColumn("action", _painted("action"))
    grp = F.floor(F.col("step") / 5).cast("long").alias("grp")
    context = f.where(F.col("step") % 5 == 0).select("variation_id", grp, "task_name", F.col("freelook").alias("look"), "inventory")
    recent = (over_chunks(spark, sf, lambda d, k: d.withColumn("_l", F.collect_list("action").over(W.w_ep(k).rowsBetween(-2, 0))), 2, 0)
              .where(F.col("step") % 5 == 4).select("variation_id", grp, F.explode("_l").alias("action")))
    return J.resolve_predictions(preds, cands, context, recent, GK)


_PAINT = "replace(replace(action, 'metal pot', 'paint in bowl'), 'orange', 'paint in jug')"
query("resolve_predictions", with_views(f"""
select variation_id, grp, case task_name when 'chemistry-mix-paint-tertiary-color' then replace(action, 'paint in bowl', 'paint in art studio in bowl')
       else replace(action, 'paint in jug', 'paint in art studio in jug') end as action, 'paint' as how
from rp where rnk = 1 and task_name in ('chemistry-mix-paint-tertiary-color', 'chemistry-mix-paint-secondary-color')
union all
select variation_id, grp, arg_min(action, rnk) as action, 'valid' as how from rh group by 1, 2
union all
select q.variation_id, q.grp, regexp_replace(coalesce(b.cand, q.pred), '[^A-Za-z0-9 ]+', '', 'g') as action, 'tokens' as how
from q1 q left join (select * from rcommon qualify row_number() over (partition by variation_id, grp order by n desc, length(cand), cand) = 1) b using (variation_id, grp)
""", FOCUS_CANDS_SQL, f"""
rg as (select distinct variation_id, grp from cands),
ctx as (select variation_id, cast(floor(step / 5) as bigint) as grp, task_name, freelook as look, inventory from v_ft where step % 5 = 0),
rp as (select p.variation_id, p.grp, p.rnk, {_PAINT.replace('action', 'p.action')} as action, c.task_name
       from preds p join rg using (variation_id, grp) join ctx c using (variation_id, grp)),
rest as (select * from rp where task_name not in ('chemistry-mix-paint-tertiary-color', 'chemistry-mix-paint-secondary-color')),
rv0 as (select variation_id, grp, regexp_replace({_PAINT}, '^examine ', 'focus on ') as action from cands
        union select variation_id, grp, concat('open door to ', unnest({ROOM_LIST_SQL})) from rg),
rv as (select distinct v.variation_id, v.grp, v.action from rv0 v join ctx c using (variation_id, grp)
       where not list_contains(list_transform(['agent', 'air'] || {ROOM_LIST_SQL}, lambda x: 'focus on ' || x), v.action)
         and not exists (select 1 from v_f f where f.variation_id = v.variation_id and f.step between 5 * v.grp + 2 and 5 * v.grp + 4 and f.action = v.action)
         and not (contains(v.action, 'door') and not contains(v.action, 'open'))
         and (not starts_with(v.action, 'focus on') or len(list_filter(string_split(regexp_replace(v.action, '(?i)\\b(?:focus|on|in|to)\\b', '', 'g'), ' '),
              lambda w: not contains(concat(c.look, ' ', lower(c.inventory)), w))) = 0)),
rh as (select r.variation_id, r.grp, r.rnk, v.action from rest r join rv v on v.variation_id = r.variation_id and v.grp = r.grp
       and v.action = {strip_sql("replace(r.action, 'green house', 'greenhouse')")} where r.rnk <= 5),
q1 as (select variation_id, grp, action as pred from rest r where rnk = 1 and not exists (select 1 from rh h where h.variation_id = r.variation_id and h.grp = r.grp)),
qt as (select distinct variation_id, grp, unnest(string_split(pred, ' ')) as tok from q1),
qc as (select distinct variation_id, grp, cand, tok from (select variation_id, grp, action as cand, unnest(string_split(action, ' ')) as tok from rv)),
rcommon as (select qc.variation_id, qc.grp, qc.cand, count(*) as n from qc join qt using (variation_id, grp, tok) group by 1, 2, 3)"""))(q_resolve)

# ============================================================== J6 / T7

VEC_N = 5


def q_vector(spark, sf):
    v = v_vecs(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return J.nearest_by_vector(v.where("is_pred"), v.where("not is_pred"), ["grp"], n=VEC_N).select(
        "grp", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "chosen")


query("join_vector_similarity", with_views(f"""
select grp, vec_id, round(score, 6) as score, rank, rank = 1 as chosen from (
  select c.grp, c.vec_id, sum(list_dot_product(c.e, p.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.e, p.e)))) as score
  from vv c join vv p on c.grp = p.grp and not c.is_pred and p.is_pred group by 1, 2)
qualify row_number() over (partition by grp order by score desc, vec_id) <= {VEC_N}
""", "vv as (select cast(floor(vec_id / 50) as bigint) as grp, vec_id, cast(embedding as double[]) as e, vec_id % 50 < 5 as is_pred from embeddings)")
    .replace("rank = 1 as chosen from (", "rank = 1 as chosen from (select *, row_number() over (partition by grp order by score desc, vec_id) as rank from (")
    .replace("group by 1, 2)\nqualify", "group by 1, 2))\nqualify"))(q_vector)

EMBED_DIM = 8


def hash_embedding():
    """A deterministic stand-in for a model: the first hex digits of a text's md5."""
    import hashlib

    def embed(texts):
        digits = [hashlib.md5(x.encode()).hexdigest() for x in texts]
        return [[int(d[4 * i:4 * i + 4], 16) / 65535.0 - 0.5 for i in range(EMBED_DIM)] for d in digits]
    return embed


query("join_text_similarity", with_views(f"""
select variation_id, grp, action, round(score, 6) as score, rank, rank = 1 as chosen from (
  select *, row_number() over (partition by variation_id, grp order by score desc, action) as rank from (
    select c.variation_id, c.grp, c.action, sum(list_dot_product(c.e, p.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.e, p.e)))) as score
    from ce c join pe p on p.variation_id = c.variation_id and p.grp = c.grp group by 1, 2, 3)) where rank <= {VEC_N}""", FOCUS_CANDS_SQL, f"""
vec as (select action, list_transform(range({EMBED_DIM}), lambda i: ('0x' || substr(md5(action), (4 * i + 1)::int, 4))::bigint / 65535.0::double - 0.5::double) as e
        from (select distinct action from v_f)),
pe as (select p.variation_id, p.grp, v.e from preds p join vec v using (action) where p.rnk <= 5),
ce as (select c.variation_id, c.grp, c.action, v.e from (select distinct variation_id, grp, action from cands) c join vec v using (action))"""))(
    lambda spark, sf: J.nearest_by_text(v_preds(spark, sf), v_cands(spark, sf), GK, hash_embedding, n=VEC_N, rank="rnk").select(
        "variation_id", "grp", "action", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "chosen"))

# ============================================================== J7


def _rewrite_inputs(spark, sf):
    f = v_f_plain(spark, sf).select("variation_id", "step", "freelook", "inventory")
    p = v_preds(spark, sf).where("rnk = 1").select("variation_id", "grp", "action")
    c = v_cands(spark, sf).select(*GK).distinct()
    p = p.join(c, GK, "left_semi")
    return p.join(f, (p.variation_id == f.variation_id) & (f.step == p.grp * 5)).drop(f.variation_id).drop("step")


def _rules_sql() -> str:
    a, inv = "a", "inventory"
    cut_in = f"(case when instr({a}, ' in ') > 0 then regexp_extract({a}, '^(.*) in ', 1) else {a} end)"
    unknown = f"regexp_replace({cut_in}, ' [A-Z]', '', 'g')"
    move_obj = f"regexp_extract({a}, 'move (.*?) to', 1)"
    no_rooms = f"(case when contains({a}, ' unknown substance ') then {unknown} else {a} end)"
    for r in fixed.ROOMS:
        no_rooms = f"replace({no_rooms}, 'in {r}', '')"
    held = f"regexp_replace({a}, '^\\S+\\s+\\S+\\s*', '')"
    place = f"instr(freelook, {held})"
    ahead = f"substr(freelook, 1, {place} - 1)"
    last = lambda c: f"(length({ahead}) - instr(reverse({ahead}), '{c}') + 1)"
    box = f"substr(freelook, greatest({last('(')} - 1, 1), greatest({last(')')} - {last('(')} + 2, 0))"
    inside = (f"(starts_with({a}, 'pick up') and {held} <> '' and {place} > 0 and substr(freelook, {place} - 8, 7) = 'called ' "
              f"and contains({ahead}, '(') and contains({ahead}, ')'))")
    b = f"(case when {inside} then replace({a}, {held}, {box}) else {a} end)"
    moves = f"(starts_with({a}, 'move') and contains({a}, 'to'))"
    rules = [
        (1, f"case when starts_with({a}, 'wait') then 'wait' end", False),
        (2, a, True),
        (3, f"replace(replace(replace({a}, 'green house', 'greenhouse'), 'adult', 'adult adult'), 'baby', 'baby baby')", True),
        (4, f"case when starts_with({a}, 'go to') then replace({a}, 'go to', 'teleport to') end", True),
        (5, f"case when starts_with({a}, 'go to') then replace({a}, 'go to', 'open door to') end", True),
        (6, f"case when starts_with({a}, 'pick up') then {b} end", True),
        (7, f"case when starts_with({a}, 'pick up') then replace({b}, 'substance in ', '') end", True),
        (8, f"case when starts_with({a}, 'focus on') and instr({inv}, {strip_sql(f"replace({a}, 'focus on', '')")}) > 0 "
            "then 'focus on substance in inventory' end", True),
        (9, f"case when {moves} and {move_obj} <> '' and instr({inv}, {move_obj}) > 0 "
            f"then replace({a}, {move_obj}, 'substance in inventory') end", True),
        (10, f"case when {moves} and not regexp_matches({a}, 'move (.*?) to') then {a} end", False),
        (11, cut_in, True),
        (12, f"case when contains({a}, ' unknown substance ') then {unknown} end", True),
        (13, no_rooms, False),
    ]
    return " union all ".join(
        f"select variation_id, grp, a as action, {n} as rule, {e} as rewritten, {str(t).lower()} as needs_valid from ri"
        for n, e, t in rules)


query("join_rewrite_rules", with_views(f"""
select r.variation_id, r.grp, r.action, arg_min(r.rewritten, r.rule) as resolved, min(r.rule) as rule
from ({_rules_sql()}) r
where r.rewritten is not null and (not r.needs_valid or exists (
  select 1 from cands c where c.variation_id = r.variation_id and c.grp = r.grp and c.action = r.rewritten))
group by 1, 2, 3""", FOCUS_CANDS_SQL, """
ri as (select p.variation_id, p.grp, p.action as a, f.freelook, f.inventory from preds p
       join v_f f on f.variation_id = p.variation_id and f.step = p.grp * 5
       where p.rnk = 1 and exists (select 1 from cands c where c.variation_id = p.variation_id and c.grp = p.grp))"""))(
    lambda spark, sf: J.rewrite_to_valid(_rewrite_inputs(spark, sf), v_cands(spark, sf), GK))

# ============================================================== J8, A8, A9

query("join_exact_match", with_views(
    "select variation_id, step, prediction, target, prediction is not distinct from target as is_match from pairs", PAIRS_SQL))(
    lambda spark, sf: (lambda p: J.match(p.select("variation_id", "step", "prediction"),
                                         p.select("variation_id", "step", "target"), ["variation_id", "step"]))(v_pairs(spark, sf)))


def _ng_sql(side: str, n: int) -> str:
    return (f"select variation_id, step, {n} as n, unnest(list_transform(generate_series(1, len({side}) - {n} + 1), "
            f"lambda i: array_to_string(list_slice({side}, i, i + {n} - 1), ' '))) as g, "
            f"{1 if side == 'h' else 0} as hc, {0 if side == 'h' else 1} as rc from toks where len({side}) >= {n}")


BLEU_SQL = with_views("""
select round(coalesce(bp * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * 100, 0.0), 4) as bleu, hyp_len, ref_len from bl3""",
    PAIRS_SQL, f"""
toks as (select variation_id, step,
           list_filter(regexp_split_to_array({strip_sql('prediction')}, '\\s+'), lambda w: w <> '') as h,
           list_filter(regexp_split_to_array({strip_sql('target')}, '\\s+'), lambda w: w <> '') as r from pairs),
ngr as ({" union all ".join(_ng_sql(s, n) for n in range(1, 5) for s in ("h", "r"))}),
per as (select variation_id, step, n, g, sum(hc) as hc, sum(rc) as rc from ngr group by 1, 2, 3, 4),
bl1 as (select {", ".join(f"cast(sum(case when n = {n} then least(hc, rc) else 0 end) as double) as m{n}" for n in range(1, 5))},
               {", ".join(f"cast(sum(case when n = {n} then hc else 0 end) as double) as t{n}" for n in range(1, 5))},
               (select cast(sum(len(h)) as double) from toks) as hyp_len, (select cast(sum(len(r)) as double) from toks) as ref_len
        from per),
bl2 as (select *, (m1 = 0)::int as z1, (m1 = 0)::int + (m2 = 0)::int as z2, (m1 = 0)::int + (m2 = 0)::int + (m3 = 0)::int as z3,
               (m1 = 0)::int + (m2 = 0)::int + (m3 = 0)::int + (m4 = 0)::int as z4 from bl1),
bl3 as (select *, case when hyp_len = 0 then 0.0 when hyp_len < ref_len then exp(1.0 - ref_len / hyp_len) else 1.0 end as bp,
               {", ".join(f"case when t{n} = 0 then null when m{n} > 0 then m{n} / t{n} else 1.0 / (pow(2.0, z{n}) * t{n}) end as p{n}" for n in range(1, 5))}
        from bl2)""")

query("agg_corpus_bleu", BLEU_SQL)(
    lambda spark, sf: A.corpus_bleu(v_pairs(spark, sf)).select(
        "bleu", F.col("hyp_len").cast("double").alias("hyp_len"), F.col("ref_len").cast("double").alias("ref_len")))

query("agg_generation_length", with_views(f"""
select round(avg(len(list_filter(regexp_split_to_array({strip_sql('prediction')}, '\\s+'), lambda w: w <> ''))), 4) as gen_len,
       round(avg(case when {strip_sql('prediction')} = {strip_sql('target')} then 1.0 else 0.0 end), 4) as exact_match from pairs""", PAIRS_SQL))(
    lambda spark, sf: A.generation_stats(v_pairs(spark, sf)))

# ============================================================== T6

query("topk_rank_common_words", with_views("""
select variation_id, grp, query, candidate, shared,
       row_number() over (partition by variation_id, grp, query order by shared desc, candidate desc) as rank from (
  select q.variation_id, q.grp, q.query, c.candidate,
         len(list_intersect(string_split(q.query, ' '), string_split(c.candidate, ' '))) as shared
  from (select distinct variation_id, grp, action as query from preds where rnk = 1) q
  join (select distinct variation_id, grp, action as candidate from cands) c
    on c.variation_id = q.variation_id and c.grp = q.grp and split_part(q.query, ' ', 1) = split_part(c.candidate, ' ', 1))""",
    FOCUS_CANDS_SQL))(
    lambda spark, sf: J.rank_candidates(v_preds(spark, sf).where("rnk = 1"), v_cands(spark, sf), GK)
    .select(*GK, "query", "candidate", F.col("shared").cast("long").alias("shared"), F.col("rank").cast("long").alias("rank")))

# ============================================================== J2 / J3 (annotation caches)


def v_answers(spark, sf):
    """Per episode: adjacent-equal sub-goal runs written as
    ``n- subgoal: {'a', 'b'} `` (FIXTURES ``v_answers``, whole episodes)."""
    from pyspark.sql import Window
    f = v_f_plain(spark, sf)
    w = Window.partitionBy("variation_id").orderBy("step")
    chg = F.when(F.lag("subgoal").over(w).isNull() | (F.lag("subgoal").over(w) != F.col("subgoal")), 1).otherwise(0)
    f = f.withColumn("run", F.sum(chg).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = f.groupBy("variation_id", "run").agg(
        F.first("subgoal").alias("sg"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "action"))),
                                 lambda x: F.concat(F.lit("'"), x["action"], F.lit("'"))), ", ").alias("acts"))
    item = F.concat(F.col("run").cast("string"), F.lit("- "), F.col("sg"), F.lit(": {"), F.col("acts"), F.lit("} "))
    return runs.groupBy("variation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", item.alias("it")))), lambda x: x["it"]), "").alias("answer"))


ANSWERS_SQL = """
runs_c as (select *, case when lag(subgoal) over w is null or lag(subgoal) over w <> subgoal then 1 else 0 end as chg
           from v_f window w as (partition by variation_id order by step)),
runs0 as (select *, sum(chg) over (partition by variation_id order by step rows between unbounded preceding and current row) as run
          from runs_c),
runs as (select variation_id, run, first(subgoal) as sg, string_agg(concat('''', action, ''''), ', ' order by step) as acts
         from runs0 group by 1, 2),
answers as (select variation_id, string_agg(concat(cast(run as varchar), '- ', sg, ': {', acts, '} '), '' order by run) as answer
            from runs group by 1)"""


def _caches(spark, sf):
    a = v_answers(spark, sf)
    primary = a.where("variation_id % 3 = 0").withColumn(
        "answer", F.when(F.col("variation_id") % 9 == 3, F.lit("")).otherwise(F.col("answer")))
    secondary = a.where("variation_id % 3 != 2")
    raw = a.where("variation_id % 5 != 0")
    return [("primary", primary), ("secondary", secondary), ("raw", raw)]


CACHES_SQL = """
c1 as (select variation_id, case when variation_id % 9 = 3 then '' else answer end as answer from answers where variation_id % 3 = 0),
c2 as (select variation_id, answer from answers where variation_id % 3 <> 2),
c3 as (select variation_id, answer from answers where variation_id % 5 <> 0)"""

query("join_annotation_fallback", with_views("""
select e.variation_id, coalesce(c1.answer, c2.answer, c3.answer) is not null as resolved,
       case when c1.answer is not null then 'primary' when c2.answer is not null then 'secondary' when c3.answer is not null then 'raw' end as source,
       md5(coalesce(c1.answer, c2.answer, c3.answer)) as answer_md5
from (select distinct variation_id from v_steps) e
left join (select * from c1 where length(answer) > 0) c1 using (variation_id)
left join (select * from c2 where length(answer) > 0) c2 using (variation_id)
left join (select * from c3 where length(answer) > 0) c3 using (variation_id)""", ANSWERS_SQL, CACHES_SQL))(
    lambda spark, sf: J.resolve_annotations(v_eps(spark, sf).select("variation_id"), _caches(spark, sf), ["variation_id"]).select(
        "variation_id", F.col("answer").isNotNull().alias("resolved"), "source", F.md5("answer").alias("answer_md5")))

query("join_annotation_missing", with_views("""
select variation_id from (select distinct variation_id from v_steps) e
where not exists (select 1 from c1 where c1.variation_id = e.variation_id and length(c1.answer) > 0)""", ANSWERS_SQL, CACHES_SQL))(
    lambda spark, sf: J.annotation_requests(v_eps(spark, sf).select("variation_id"), _caches(spark, sf)[0][1], ["variation_id"]))

# ============================================================== X jobs


def q_formalize(spark, sf):
    s = v_steps(spark, sf)
    counts = s.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    # the rules run once per distinct action, then the counts carry the rows
    return counts.select("action", formalize("action").alias("formal"), "n")


query("job_formalize_actions", with_views(
    f"select action, {formalize_sql('action')} as formal, count(*) as n from v_steps group by action"))(q_formalize)

query("job_formalize_coverage", with_views(
    f"select coalesce(nullif(regexp_extract({formalize_sql('action')}, '^([A-Z_]+)\\(', 1), ''), 'UNMATCHED') as verb, "
    "count(*) as n_rows, count(distinct action) as n_actions from v_steps group by 1"))(
    lambda spark, sf: q_formalize(spark, sf).groupBy(
        F.coalesce(F.nullif(formal_verb("formal"), F.lit("")), F.lit("UNMATCHED")).alias("verb")).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_actions")))


def q_recover(spark, sf):
    a = v_steps(spark, sf).select("action").distinct().withColumn("formal", formalize("action"))
    return a.select("action", "formal", recover("formal").alias("recovered"),
                    recover("formal").eqNullSafe(F.col("action")).alias("roundtrip"))


query("job_recover_actions", with_views(
    f"select action, formal, {recover_sql('formal')} as recovered, {recover_sql('formal')} is not distinct from action as roundtrip "
    f"from (select distinct action, {formalize_sql('action')} as formal from v_steps)"))(q_recover)

query("sanitize_text", with_views(f"select variation_id, pos, {sanitize_sql('freelook')} as look from v_steps"))(
    lambda spark, sf: v_steps(spark, sf).select("variation_id", "pos", sanitize("freelook").alias("look")))

query("extract_objects", with_views(f"select variation_id, pos, array_to_string({mentions_sql('freelook')}, ', ') as objects from v_steps"))(
    lambda spark, sf: v_steps(spark, sf).select("variation_id", "pos", F.array_join(object_mentions("freelook"), ", ").alias("objects")))


def _clean_look_sql(x: str, lite: bool) -> str:
    cut = f"(case when instr({x}, 'You also see:') > 0 then split_part({x}, 'You also see:', 1) else {x} end)"
    lines = f"list_filter(string_split({cut}, chr(10)), lambda l: {strip_sql('l')} <> '')"
    keep = "lambda l: contains(l, 'In it, you see:') or not (contains(l, 'the agent') or contains(l, ' air'))"
    lines = f"list_filter({lines}, {keep})"
    if lite:
        lines = f"list_filter({lines}, lambda l: not contains(l, 'In it, you see:'))"
    lines = f"list_transform({lines}, lambda l: case when contains(l, 'In it, you see:') then l else {strip_sql(chr(39).join(['replace(l, ', 'substance called ', ', ', ' ', ')']))} end)"
    if lite:
        pre = "regexp_extract(l, '^([A-Za-z ]*)', 1)"
        lines = f"list_transform({lines}, lambda l: case when length({pre}) > 0 and length({pre}) < length(l) then {strip_sql(pre)} else l end)"
        return f"array_to_string({lines}, ', ')"
    return f"array_to_string({lines}, chr(10) || ' ' || chr(9) || ' - ')"


query("clean_look", with_views(
    f"select variation_id, pos, {_clean_look_sql('freelook', True)} as lite, {_clean_look_sql('freelook', False)} as full_look from v_steps"))(
    lambda spark, sf: v_steps(spark, sf).select("variation_id", "pos", clean_look("freelook", lite=True).alias("lite"),
                                                clean_look("freelook").alias("full_look")))

ROOMS_SQL = "[" + ", ".join(f"'{r}'" for r in fixed.ROOMS) + "]"
query("current_room", with_views(
    f"select variation_id, pos, list_filter({ROOMS_SQL}, lambda r: contains(split_part(freelook, '.', 1), 'called the ' || r))[1] as room from v_steps"))(
    lambda spark, sf: v_steps(spark, sf).select("variation_id", "pos", current_room("freelook").alias("room")))


def _gen_text(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    wrapped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<pad><extra_id_0> "), F.col("text"), F.lit("<extra_id_1></s>"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", wrapped.alias("raw"))


query("strip_generation", with_views(f"""
select conv_id, turn, {strip_sql("array_to_string(list_filter(string_split(replace(body, '<', ' <'), ' '), lambda t: " + strip_sql('t') + " <> '' and not starts_with(t, '<')), ' ')")} as cleaned
from (select conv_id, turn, case when regexp_matches(raw, '^.*<extra_id_0>(.*)<extra_id_1>') then regexp_extract(raw, '^.*<extra_id_0>(.*)<extra_id_1>', 1) else raw end as body
      from (select conv_id, turn, case when turn % 2 = 0 then concat('<pad><extra_id_0> ', text, '<extra_id_1></s>') else text end as raw from conversations))"""))(
    lambda spark, sf: _gen_text(spark, sf).select("conv_id", "turn", strip_generation("raw").alias("cleaned")))

query("focus_targets", with_views(
    "select distinct task_no, task_desc, array_to_string(list_transform(list_concat(regexp_extract_all(task_desc, 'focus on\\s+(\\w+(?:\\s+\\w+)*)', 1), "
    "regexp_extract_all(replace(task_desc, 'a(n)', 'a'), 'find\\s+(\\w+(?:\\s+\\w+)*)', 1)), lambda x: " + strip_sql("replace(x, 'the ', ' ')") + "), ', ') as targets from v_ft"))(
    lambda spark, sf: v_f(spark, sf).select("task_no", "task_desc").distinct()          # 30 texts, not one an event
    .select("task_no", "task_desc", F.array_join(focus_targets("task_desc"), ", ").alias("targets")))


def perturb_subgoal(df, seed: int = 1, col: str = "subgoal", objects: str = "objects"):
    """X11: arguments of a sub-goal ``name(a)`` / ``name(a, b)`` are replaced
    by a seeded-random room (when the argument is a room) or a random object
    from ``objects``.  The two-argument form checks both arguments without
    the ``(`` the original leaves on the first one."""
    s = F.col(col)
    st, en = F.instr(s, "("), F.instr(s, ")")
    params = F.substring(s, st + 1, F.greatest(en - st - 1, F.lit(0)))
    two = params.contains(",")
    p1 = F.when(two, F.substring_index(params, ",", 1)).otherwise(params)
    p2 = F.when(two, F.expr("substring(params_, instr(params_, ',') + 1)"))
    rooms = F.array(*[F.lit(r) for r in fixed.ROOMS])

    def pick(p, salt):
        arg = py_strip(py_strip(p), ",")
        h = seeded_int(seed, "variation_id", "step", salt)
        room = F.element_at(rooms, (F.pmod(h, F.lit(len(fixed.ROOMS))) + 1).cast("int"))
        obj = F.try_element_at(F.col(objects), (F.pmod(h, F.greatest(F.size(objects), F.lit(1))) + 1).cast("int"))
        return F.when(F.array_contains(rooms, arg), room).otherwise(obj)

    d = df.withColumn("params_", params).withColumn("_s1", F.lit("1")).withColumn("_s2", F.lit("2"))
    new = F.concat(F.substring(s, 1, st - 1), F.lit("("), pick(p1, "_s1"),
                   F.when(two, F.concat(F.lit(", "), pick(p2, "_s2"))).otherwise(F.lit("")),
                   F.expr(f"substring({col}, instr({col}, ')'))"))
    return d.withColumn("perturbed", F.when((st > 0) & (en > st), new).otherwise(s)).drop("params_", "_s1", "_s2")


def q_perturb(spark, sf):
    f = v_f_plain(spark, sf).withColumn("objects", object_mentions("freelook"))
    return perturb_subgoal(f).select("variation_id", "step", "subgoal", "perturbed")


query("perturb_subgoal", with_views(f"""
select variation_id, step, subgoal,
  case when instr(subgoal, '(') > 0 and instr(subgoal, ')') > instr(subgoal, '(') then
    concat(substr(subgoal, 1, instr(subgoal, '(') - 1), '(',
      case when list_contains({ROOMS_SQL}, regexp_replace({strip_sql('p1')}, '^,+|,+$', '', 'g'))
           then {ROOMS_SQL}[(h1 % {len(fixed.ROOMS)}) + 1] else objs[(h1 % greatest(len(objs), 1)) + 1] end,
      case when contains(params, ',') then concat(', ',
        case when list_contains({ROOMS_SQL}, regexp_replace({strip_sql('p2')}, '^,+|,+$', '', 'g'))
             then {ROOMS_SQL}[(h2 % {len(fixed.ROOMS)}) + 1] else objs[(h2 % greatest(len(objs), 1)) + 1] end) else '' end,
      substr(subgoal, instr(subgoal, ')')))
  else subgoal end as perturbed
from (select *, case when contains(params, ',') then split_part(params, ',', 1) else params end as p1,
             substr(params, instr(params, ',') + 1) as p2,
             ('0x' || substr(md5(concat_ws('|', '1', cast(variation_id as varchar), cast(step as varchar), '1')), 1, 8))::bigint as h1,
             ('0x' || substr(md5(concat_ws('|', '1', cast(variation_id as varchar), cast(step as varchar), '2')), 1, 8))::bigint as h2
      from (select *, substr(subgoal, instr(subgoal, '(') + 1, greatest(instr(subgoal, ')') - instr(subgoal, '(') - 1, 0)) as params,
                   {mentions_sql('freelook')} as objs from v_f))"""))(q_perturb)

TRUNC_SRC, TRUNC_TGT = 1024, 30


def q_truncate(spark, sf):
    ex = compose(v_f(spark, sf), RECIPES["action_raw"])
    n_in = F.size(F.split(py_strip("input"), r"\s+"))
    return ex.select("variation_id", "step", n_in.cast("long").alias("input_tokens"), (n_in > TRUNC_SRC).alias("input_over"),
                     F.length(truncate_tokens("input", TRUNC_SRC)).cast("long").alias("input_chars"),
                     truncate_tokens("target", TRUNC_TGT).alias("target"))


def _truncate_sql():
    from .q_compose import compose_sql
    toks = f"regexp_split_to_array({strip_sql('input')}, '\\s+')"
    tgt = f"regexp_split_to_array({strip_sql('target')}, '\\s+')"
    return (f"select variation_id, step, len({toks}) as input_tokens, len({toks}) > {TRUNC_SRC} as input_over, "
            f"length(array_to_string(list_slice({toks}, 1, {TRUNC_SRC}), ' ')) as input_chars, "
            f"array_to_string(list_slice({tgt}, 1, {TRUNC_TGT}), ' ') as target "
            f"from ({compose_sql(RECIPES['action_raw'])})")


query("truncate_lengths", _truncate_sql())(q_truncate)

#: A public tokenizer's file, by name; callers give the path of their own.
TOKENIZER = "byte_bpe_50k.json"


def q_truncate_tokenizer(spark, sf):
    import public_tokenizers
    ex = compose(v_f(spark, sf), RECIPES["action_raw"]).select("variation_id", "step", "input", "target")
    hook = library_tokenizer(str(public_tokenizers.path(TOKENIZER)))
    return truncate_by_tokenizer(ex, {"input": TRUNC_SRC // 4, "target": TRUNC_TGT // 6}, hook)


query("truncate_lengths_tokenizer")(q_truncate_tokenizer)

# ============================================================== T7

TOPK_N = 3


def q_topk_vector(spark, sf):
    v = v_vecs(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return J.nearest_by_vector(v.where("is_pred"), v.where("not is_pred"), ["grp"], n=TOPK_N, pick="nth").select(
        "grp", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "chosen")


query("topk_vector", with_views(f"""
select grp, vec_id, round(score, 6) as score, rank, rank = least({TOPK_N}, m) as chosen from (
  select *, row_number() over (partition by grp order by score desc, vec_id) as rank, count(*) over (partition by grp) as m0 from (
    select c.grp, c.vec_id, sum(list_dot_product(c.e, p.e) / (sqrt(list_dot_product(c.e, c.e)) * sqrt(list_dot_product(p.e, p.e)))) as score
    from vv c join vv p on c.grp = p.grp and not c.is_pred and p.is_pred group by 1, 2))
  , lateral (select least(m0, {TOPK_N}) as m)
where rank <= {TOPK_N}""", "vv as (select cast(floor(vec_id / 50) as bigint) as grp, vec_id, cast(embedding as double[]) as e, vec_id % 50 < 5 as is_pred from embeddings)"))(
    q_topk_vector)
