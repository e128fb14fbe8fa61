"""Joins, lookups and candidate matching.

Matching always joins *within* a step key (never a global cross join): a
candidate set and a prediction list share ``keys`` and every pairwise
comparison is an equi-join on those keys.  Small fixed dimensions (30 tasks,
11 rooms) are broadcast; everything else is left to AQE, which turns a join
into a broadcast only when the runtime size of a side is below its threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.hooks import embed_texts
from ..functions.text import py_strip
from .filters import normalise_task_col


# --- J1 ----------------------------------------------------------------------

def with_real_id(df: DataFrame, dim: DataFrame, name: str = "task_name") -> DataFrame:
    """Task name -> real id and group via the 30-row dimension
    (``mendelian`` is respelled first); misses get null ids."""
    fixed_name = F.replace(normalise_task_col(name), F.lit(fixed.TASK_NAME_FIX[0]), F.lit(fixed.TASK_NAME_FIX[1]))
    d = dim.select(F.col("task_name").alias("_dim_name"), "task_real_id")
    out = df.withColumn("_lookup", fixed_name).join(F.broadcast(d), F.col("_lookup") == F.col("_dim_name"), "left")
    return (out.withColumn("task_group", F.split("task_real_id", "-").getItem(0))
            .drop("_lookup", "_dim_name"))


EPISODE = ("task_no", "variation_id")


# --- J2 / J3: annotation caches ------------------------------------------------

def resolve_annotations(eps: DataFrame, caches: Sequence[tuple[str, DataFrame]],
                        keys: Sequence[str] = EPISODE, answer: str = "answer", order: str | None = None) -> DataFrame:
    """The first non-empty answer from an ordered list of caches
    (``(source_name, df[keys, answer])``); ``source`` tags which one.  Of several rows a
    key the first written counts (column ``order``; without it the least answer)."""
    out = eps
    vals, srcs = [], []
    for i, (name, c) in enumerate(caches):
        col = f"_a{i}"
        good = c.where(F.col(answer).isNotNull() & (F.length(F.col(answer)) > 0))
        good = good.groupBy(*keys).agg((F.min_by(answer, order) if order else F.min(answer)).alias(col))
        out = out.join(good, list(keys), "left")
        vals.append(F.col(col))
        srcs.append(F.when(F.col(col).isNotNull(), F.lit(name)))
    out = out.withColumn(answer, F.coalesce(*vals)).withColumn("source", F.coalesce(*srcs))
    return out.drop(*[f"_a{i}" for i in range(len(caches))])


def annotation_requests(eps: DataFrame, cache: DataFrame, keys: Sequence[str] = EPISODE,
                        answer: str = "answer") -> DataFrame:
    """Episodes without a usable (non-empty) cached answer."""
    good = cache.where(F.col(answer).isNotNull() & (F.length(F.col(answer)) > 0)).select(*keys)
    return eps.join(good, list(keys), "left_anti")


# --- J4 / J5: prediction vs valid candidates ---------------------------------

def pick_valid(preds: DataFrame, cands: DataFrame, keys: Sequence[str], k: int = 5,
               rank: str = "rnk", text: str = "action") -> DataFrame:
    """The first of the top-k predictions (trimmed, ``green house`` ->
    ``greenhouse``) that is a valid candidate.  Equi-join on (keys, text) then
    ``min_by`` rank; groups without a hit are absent."""
    p = preds.where(F.col(rank) <= k).select(
        *keys, rank, py_strip(F.replace(F.col(text), F.lit("green house"), F.lit("greenhouse"))).alias("_p"))
    c = cands.select(*keys, F.col(text).alias("_p")).distinct()
    hit = p.join(c, [*keys, "_p"], "inner")
    return hit.groupBy(*keys).agg(F.min_by("_p", rank).alias("action"), F.min(rank).alias("rank"))


def nearest_by_tokens(preds: DataFrame, cands: DataFrame, keys: Sequence[str], rank: str = "rnk",
                      text: str = "action") -> DataFrame:
    """Candidate sharing the most distinct space-separated words with
    prediction 1; ties -> shorter, then lexical; no word in common ->
    prediction 1.  The result has ``[^A-Za-z0-9 ]`` removed.

    Token overlap is computed by exploding both sides to (keys, token) and
    equi-joining, so only pairs that share a token are ever formed."""
    p1 = preds.where(F.col(rank) == 1).select(*keys, F.col(text).alias("_pred"))
    pt = p1.select(*keys, F.explode(F.array_distinct(F.split("_pred", " "))).alias("_tok"))
    c = cands.select(*keys, F.col(text).alias("_cand")).distinct()
    ct = c.select(*keys, "_cand", F.explode(F.array_distinct(F.split("_cand", " "))).alias("_tok"))
    common = ct.join(pt, [*keys, "_tok"], "inner").groupBy(*keys, "_cand").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.length("_cand"), "_cand")
    best = common.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*keys, "_cand", "_n")
    out = p1.join(best, list(keys), "left")
    chosen = F.coalesce(F.col("_cand"), F.col("_pred"))
    return out.select(*keys, F.regexp_replace(chosen, r"[^A-Za-z0-9 ]+", "").alias("action"),
                      F.coalesce(F.col("_n"), F.lit(0)).alias("overlap"))


def fix_paint(preds: DataFrame, task_name: str = "task_name", rank: str = "rnk", text: str = "action") -> DataFrame:
    """The first prediction of the two paint-mixing tasks, with the studio written
    out; these tasks take it as it is."""
    a = F.col(text)
    return preds.where((F.col(rank) == 1) & F.col(task_name).isin(list(fixed.PAINT_CONTAINERS))).withColumn(text, F.coalesce(*[
        F.when(F.col(task_name) == task, F.replace(a, F.lit(f"paint in {box}"), F.lit(f"paint in art studio in {box}"))) for task, box in fixed.PAINT_CONTAINERS.items()]))


def resolve_predictions(preds: DataFrame, cands: DataFrame, context: DataFrame, recent: DataFrame, keys: Sequence[str],
                        k: int = 5, rank: str = "rnk", text: str = "action", vectors: DataFrame | None = None) -> DataFrame:
    """Ranked predictions -> one action a step, as one job: valid actions are the
    candidates plus doors (U2) without impossible focus (U3), recent actions (W19),
    closed doors (F8) and focus on what is not seen (F7); the first valid of the top
    ``k`` predictions wins (J4), else the most similar valid action: by ``vectors``
    (keys, action, score of J6) when given, else by shared words (J5).  Paint tasks take
    their first prediction.  ``context``: keys, task_name, look, inventory; ``recent``: keys,
    action.  Adds ``how``: paint, valid, vector or tokens."""
    from .filters import open_doors_only, visible_focus
    named = preds.join(context.select(*keys, "task_name"), list(keys))
    paint = fix_paint(named, rank=rank, text=text).select(*keys, text, F.lit("paint").alias("how"))
    rest = named.where(~F.coalesce(F.col("task_name").isin(list(fixed.PAINT_CONTAINERS)), F.lit(False))).drop("task_name")
    valid = exclude_recent(drop_invalid_focus(extend_valid(cands, None, keys, text), text), recent, keys, text)
    valid = visible_focus(open_doors_only(valid, text).join(context.select(*keys, "look", "inventory"), list(keys)), text, "look").select(*keys, text)
    hit = pick_valid(rest, valid, keys, k, rank, text).select(*keys, text, F.lit("valid").alias("how"))
    left = rest.join(hit.select(*keys), list(keys), "left_anti")
    if vectors is not None:
        best = vectors.join(valid, [*keys, text]).groupBy(*keys).agg(F.max_by(text, "score").alias(text))
        near = left.select(*keys).distinct().join(best, list(keys)).select(*keys, text, F.lit("vector").alias("how"))
    else:
        near = nearest_by_tokens(left, valid, keys, rank, text).select(*keys, text, F.lit("tokens").alias("how"))
    return paint.unionByName(hit).unionByName(near)


# --- J6 / T7: vector similarity -------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, v: s + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def nearest_by_vector(preds: DataFrame, cands: DataFrame, keys: Sequence[str], n: int = 5,
                      vec: str = "embedding", item: str = "vec_id", pick: str = "best",
                      rank: str | None = None, k: int = 5) -> DataFrame:
    """Per candidate, the sum of cosine similarities to the group's
    first ``k`` predictions (by ``rank``; by ``item`` without it); keep the top ``n`` by that sum (``rank`` 1 = best).

    ``pick='nth'`` reproduces the original's choice of the n-th best as the
    answer (flag ``chosen``); ``'best'`` flags rank 1.  Pairs are formed only
    within a group key."""
    first = Window.partitionBy(*keys).orderBy(rank or item)
    p = preds.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k).select(*keys, F.col(vec).alias("_pv"))
    p = p.withColumn("_pn", _norm(F.col("_pv")))
    c = cands.select(*keys, item, F.col(vec).alias("_cv")).withColumn("_cn", _norm(F.col("_cv")))
    pairs = c.join(p, list(keys), "inner")
    cos = _dot(F.col("_cv"), F.col("_pv")) / (F.col("_cn") * F.col("_pn"))
    sims = pairs.groupBy(*keys, item).agg(F.sum(cos).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), item)
    ranked = sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    # candidates kept in the group (n, or fewer when the group is small)
    ranked = ranked.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    target = F.lit(1) if pick == "best" else F.least(F.lit(n), F.col("_m"))
    return ranked.withColumn("chosen", F.col("rank") == target).drop("_m")


def nearest_by_text(preds: DataFrame, cands: DataFrame, keys: Sequence[str], hook: Callable, n: int = 5,
                    text: str = "action", pick: str = "best", rank: str | None = None, k: int = 5) -> DataFrame:
    """J6 on texts: the distinct texts of both sides are embedded once by the ``hook``
    (``functions.hooks.embed_texts``) and their vectors joined back; only the first
    ``k`` predictions of a group take part, so a candidate meets at most ``k``."""
    first = Window.partitionBy(*keys).orderBy(rank or text)
    p = preds.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k).select(*keys, text, *([rank] if rank else []))
    c = cands.select(*keys, text).distinct()
    vectors = embed_texts(p.select(text).unionByName(c.select(text)), hook, text)
    return nearest_by_vector(p.join(vectors, text), c.join(vectors, text), keys, n, item=text, pick=pick, rank=rank, k=k)


# --- J7: rewrite rules ------------------------------------------------------------

def rewrite_candidates(actions: DataFrame, keys: Sequence[str], text: str = "action",
                       look: str = "freelook", inventory: str = "inventory") -> DataFrame:
    """J7 rule table: one row per (action, rule_no, rewritten text, needs_valid).

    Rules, in order: 1 ``wait*`` -> ``wait`` (no validity test); 2 identity;
    3 greenhouse/adult/baby doubling; 4 ``go to`` -> ``teleport to``;
    5 ``go to`` -> ``open door to``; 6 ``pick up X`` where the look names X as what a
    container is ``called`` -> X replaced by the container; 7 the action itself when it is
    valid without ``substance in `` (of a pick up); 8 ``focus on X`` with X in the inventory
    -> ``focus on substance in inventory``; 9 ``move X to ...`` with X in the inventory -> X
    replaced by ``substance in inventory``; 10 a ``move`` that names ``to`` but no object is
    left as it is (no test); 11 cut at the last `` in ``; 12 `` unknown substance `` -> cut
    at last `` in `` then drop single capital letters; 13 room suffixes ``in <room>``
    removed (no test).  A pick up goes on as rewritten by rule 6."""
    given = F.col(text)
    held = F.regexp_replace(given, r"^\S+\s+\S+\s*", "")
    look_at = F.col(look)
    place = F.instr(look_at, held)
    # the last parenthesis before the object, with the character before it
    ahead = F.substring(look_at, F.lit(1), place - 1)
    opened = F.length(ahead) - F.instr(F.reverse(ahead), "(") + 1
    closed = F.length(ahead) - F.instr(F.reverse(ahead), ")") + 1
    container = F.substring(look_at, F.greatest(opened - 1, F.lit(1)), F.greatest(closed - opened + 2, F.lit(0)))
    inside = given.startswith("pick up") & (held != "") & (place > 0) & (F.substring(look_at, place - 8, F.lit(7)) == "called ") & ahead.contains("(") & ahead.contains(")")
    a = F.when(inside, F.replace(given, held, container)).otherwise(given)
    picks = given.startswith("pick up")
    inv = F.col(inventory)
    cut_in = F.when(F.instr(a, " in ") > 0,
                    F.regexp_extract(a, r"^(.*) in ", 1)).otherwise(a)
    doubled = F.replace(F.replace(F.replace(given, F.lit("green house"), F.lit("greenhouse")),
                                  F.lit("adult"), F.lit("adult adult")), F.lit("baby"), F.lit("baby baby"))
    focus_obj = py_strip(F.replace(a, F.lit("focus on"), F.lit("")))
    move_obj = F.regexp_extract(a, r"move (.*?) to", 1)
    moves = a.startswith("move") & a.contains("to")
    unknown = F.regexp_replace(cut_in, r" [A-Z]", "")
    # rule 9 keeps its rewrite for rule 10
    no_rooms = F.when(a.contains(" unknown substance "), unknown).otherwise(a)
    for r in fixed.ROOMS:
        no_rooms = F.replace(no_rooms, F.lit("in " + r), F.lit(""))
    rules = [
        (1, F.when(given.startswith("wait"), F.lit("wait")), False),
        (2, given, True),
        (3, doubled, True),
        (4, F.when(a.startswith("go to"), F.replace(a, F.lit("go to"), F.lit("teleport to"))), True),
        (5, F.when(a.startswith("go to"), F.replace(a, F.lit("go to"), F.lit("open door to"))), True),
        (6, F.when(picks, a), True),
        (7, F.when(picks, F.replace(a, F.lit("substance in "), F.lit(""))), True),
        (8, F.when(a.startswith("focus on") & (F.instr(inv, focus_obj) > 0), F.lit("focus on substance in inventory")), True),
        (9, F.when(moves & (move_obj != "") & (F.instr(inv, move_obj) > 0), F.replace(a, move_obj, F.lit("substance in inventory"))), True),
        (10, F.when(moves & ~a.rlike("move (.*?) to"), a), False),
        (11, cut_in, True),
        (12, F.when(a.contains(" unknown substance "), unknown), True),
        (13, no_rooms, False),
    ]
    # rule 7 tests the shorter text but answers with the action
    arr = F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("rewritten"), (a if n == 7 else v).alias("answer"), F.lit(t).alias("needs_valid"))
                    for n, v, t in rules])
    return actions.select(*keys, text, F.inline(arr)).where(F.col("rewritten").isNotNull())


def rewrite_to_valid(actions: DataFrame, cands: DataFrame, keys: Sequence[str], text: str = "action",
                     look: str = "freelook", inventory: str = "inventory") -> DataFrame:
    """The first rule whose rewrite is a valid candidate (or needs no
    test).  Semi-join on (keys, text) then ``min_by(rewritten, rule)``."""
    rc = rewrite_candidates(actions, keys, text, look, inventory)
    valid = cands.select(*keys, F.col(text).alias("rewritten")).distinct().withColumn("_valid", F.lit(True))
    j = rc.join(valid, [*keys, "rewritten"], "left")
    ok = j.where(~F.col("needs_valid") | F.col("_valid").isNotNull())
    return ok.groupBy(*keys, text).agg(F.min_by("answer", "rule").alias("resolved"), F.min("rule").alias("rule"))


# --- J8 ---------------------------------------------------------------------------

def match(preds: DataFrame, targets: DataFrame, keys: Sequence[str], pred: str = "prediction",
          target: str = "target") -> DataFrame:
    """Predicted vs target, row by row on the example key (null-safe)."""
    j = preds.select(*keys, pred).join(targets.select(*keys, target), list(keys), "inner")
    return j.withColumn("is_match", F.col(pred).eqNullSafe(F.col(target)))


# --- U2 / U3 ----------------------------------------------------------------------

def rooms_df(spark) -> DataFrame:
    return spark.createDataFrame([(r,) for r in fixed.ROOMS], "room string")


def extend_valid(cands: DataFrame, spark, keys: Sequence[str], text: str = "action",
                 with_wait: bool = False) -> DataFrame:
    """Valid ∪ {``open door to`` r : rooms} (∪ ``wait``, ``wait1``)."""
    groups = cands.select(*keys).distinct()
    extra = [F.concat(F.lit("open door to "), F.lit(r)) for r in fixed.ROOMS]
    if with_wait:
        extra += [F.lit("wait"), F.lit("wait1")]
    add = groups.select(*keys, F.explode(F.array(*extra)).alias(text))
    return cands.select(*keys, text).unionByName(add).distinct()


def drop_invalid_focus(cands: DataFrame, text: str = "action") -> DataFrame:
    """Remove ``focus on`` agent / air / any room."""
    bad = [f"focus on {x}" for x in fixed.INVALID_FOCUS_EXTRA + fixed.ROOMS]
    return cands.where(~F.col(text).isin(bad))


def exclude_recent(cands: DataFrame, recent: DataFrame, keys: Sequence[str], text: str = "action") -> DataFrame:
    """Candidate set minus the last taken actions (``recent`` holds them)."""
    return cands.join(recent.select(*keys, text).distinct(), [*keys, text], "left_anti")


# --- T6 ---------------------------------------------------------------------------

def rank_candidates(queries: DataFrame, cands: DataFrame, keys: Sequence[str], text: str = "action") -> DataFrame:
    """For each query, the candidates of the same group (``keys``, e.g.
    one step's valid actions) whose first word equals the query's, ranked
    by (shared words, text) descending.  An equi-join on (keys, first word)
    of distinct texts: pairs exist only inside one group's candidate set."""
    q = queries.select(*keys, F.col(text).alias("query")).distinct() \
        .withColumn("_fw", F.split("query", " ").getItem(0))
    c = cands.select(*keys, F.col(text).alias("candidate")).distinct() \
        .withColumn("_fw", F.split("candidate", " ").getItem(0))
    j = q.join(c, [*keys, "_fw"], "inner")
    shared = F.size(F.array_intersect(F.split("query", " "), F.split("candidate", " ")))
    j = j.withColumn("shared", shared)
    w = Window.partitionBy(*keys, "query").orderBy(F.desc("shared"), F.desc("candidate"))
    return j.withColumn("rank", F.row_number().over(w)).drop("_fw")
