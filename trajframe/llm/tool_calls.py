"""Operator 7, tool calls linked to results, ordered, validated, serialised.

Calls and results are hash-joined by conversation and call identifier, calls and
tool schemas by tool name.  Arguments are parsed, checked against the tool's JSON
schema (``type``, ``properties``, ``required``, ``enum``, ``items``,
``additionalProperties: false``) and written as canonical JSON: sorted keys, no
blanks, no escapes beyond those JSON needs.  A string value ``$result:<id>`` in the
arguments refers to another call of the conversation, which must come first.

Where all references point back, the order of turns is a topological order.  Only
conversations with a reference forward are levelled, in rounds of joins, one a
level; calls that wait for each other keep no level and come last (``cycle``).
Positions are counted in two levels (stretches of turns, then inside one), so a
conversation with a third of all calls is not one sort.

Status, the first that holds: ``duplicate`` (an earlier row has the identifier),
``unknown tool``, ``invalid`` (see ``errors``), ``cycle``, ``no result``, ``ok``.  Defined
cases: a null conversation, turn or identifier takes no part; null or malformed
arguments are invalid; of several results the earliest counts, ties by content; a
null content is a result; references to missing calls are errors.

A result that no call asks for has no row here: it is no call.  A message without role
is a result, not a call; texts are taken whole."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard

REFERENCE = "$result:"
STRETCH = 1024
TYPES = {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What of a value breaks its schema."""
    found = []
    kind = schema.get("type")
    if kind in ("integer", "number"):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    else:
        fits = kind is None or isinstance(value, TYPES.get(kind, object))
    if not fits:
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        if schema.get("additionalProperties") is False:
            found += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                found += faults(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += faults(x, schema["items"], f"{at}[{i}]")
    return found


def references(value) -> set[str]:
    if isinstance(value, str):
        return {value[len(REFERENCE):]} if value.startswith(REFERENCE) else set()
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(references, inner))


def _records(batches):
    for batch in batches:
        records, needs, errors = [], [], []
        for call, name, arguments, schema, content, linked in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "schema", "content", "linked"))):
            try:
                value = json.loads(arguments)
                written = canonical(value)
                wrong = faults(value, json.loads(schema)) if schema else []
                refers = sorted(references(value))
            except (TypeError, ValueError, RecursionError):
                written, wrong, refers = "null", ["$: not JSON"], []
            result = f',"result":{canonical(content)}' if linked else ""
            records.append(f'{{"arguments":{written},"id":{canonical(call)},"name":{canonical(name)}{result}}}')
            needs.append(refers), errors.append(wrong)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "turn", "call_id", "name", "linked", "repeated", "known")), pa.array(records, pa.string()),
             pa.array(needs, pa.list_(pa.string())), pa.array(errors, pa.list_(pa.string()))],
            ["conv_id", "turn", "call_id", "name", "linked", "repeated", "known", "record", "needs", "errors"])


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls in conversations with a reference
    forward: the longest chain of calls before each; none for calls in or after a cycle."""
    mixed_up = edges.where("forward").select("conv_id").distinct()
    waiting = cut(edges.join(mixed_up, "conv_id").select("conv_id", "call_id", "needs_id"), "waiting")
    done = cut(calls.join(mixed_up, "conv_id").join(waiting, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level")), "done")
    rounds, fresh = [done], done
    while True:
        served = fresh.select("conv_id", F.col("call_id").alias("needs_id"))
        left = cut(waiting.join(served, ["conv_id", "needs_id"], "left_anti").select("conv_id", "call_id", "needs_id"), "waiting")
        fresh = cut(waiting.select("conv_id", "call_id").distinct().join(left, ["conv_id", "call_id"], "left_anti")
                    .select("conv_id", "call_id", F.lit(len(rounds)).alias("level")), "done")
        discard(waiting)
        waiting = left
        if fresh.isEmpty():
            break
        rounds.append(fresh)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    stuck = waiting.select("conv_id", "call_id").distinct().select("conv_id", "call_id", F.lit(None).cast("int").alias("level"))
    return out.unionByName(stuck)


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """``conv_id, position, turn, call_id, name, status, errors, record`` of
    ``calls(conv_id, turn, call_id, name, arguments)`` with ``results(conv_id, turn,
    call_id, content)`` and ``tools(name, schema)``."""
    calls = calls.where("conv_id is not null and turn is not null and call_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments")
    own = Window.partitionBy("conv_id", "call_id").orderBy("turn", F.col("name").asc_nulls_last(), F.col("arguments").asc_nulls_last())
    calls = calls.withColumn("repeated", F.row_number().over(own) > 1)
    answers = (results.where("conv_id is not null and turn is not null and call_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "turn", "content")
               .groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_r")).select("conv_id", "call_id", F.col("_r.content").alias("content"), F.lit(True).alias("linked")))
    schemas = tools.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema")).withColumn("known", F.lit(True))
    joined = (calls.join(answers, ["conv_id", "call_id"], "left").join(schemas, "name", "left")
              .select("conv_id", "turn", "call_id", "name", "arguments", "schema", "content", "repeated",
                      F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("known", F.lit(False)).alias("known")))
    rows = cut(joined.mapInArrow(_records, "conv_id long, turn long, call_id string, name string, linked boolean, repeated boolean, known boolean, "
                                           "record string, needs array<string>, errors array<string>"), "records")

    first = rows.where("not repeated")
    asked = first.select("conv_id", "call_id", "turn", F.explode("needs").alias("needs_id"))
    there = first.select("conv_id", F.col("call_id").alias("needs_id"), F.col("turn").alias("needs_turn"))
    edges = cut(asked.join(there, ["conv_id", "needs_id"], "left").withColumn(
        "forward", F.struct("needs_turn", "needs_id") >= F.struct("turn", "call_id")), "edges")
    missing = (edges.where("needs_turn is null").groupBy("conv_id", "call_id")
               .agg(F.sort_array(F.collect_list(F.concat(F.lit("no call "), "needs_id"))).alias("missing")).withColumn("repeated", F.lit(False)))
    level = levels(first.select("conv_id", "call_id"), edges.where("needs_turn is not null")).withColumn("repeated", F.lit(False)).withColumn("levelled", F.lit(True))
    placed = cut(rows.join(missing, ["conv_id", "call_id", "repeated"], "left").join(level, ["conv_id", "call_id", "repeated"], "left")
                 .withColumn("errors", F.concat("errors", F.coalesce("missing", F.array().cast("array<string>"))))
                 .withColumn("cycle", F.coalesce(F.col("levelled"), F.lit(False)) & F.col("level").isNull())
                 .withColumn("part", F.struct(F.col("cycle").cast("int").alias("c"), F.coalesce("level", F.lit(0)).alias("l"), F.floor(F.col("turn") / STRETCH).alias("s"))), "placed")
    before = placed.groupBy("conv_id", "part").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "call_id", "record")
    status = (F.when(F.col("repeated"), "duplicate").when(~F.col("known"), "unknown tool").when(F.size("errors") > 0, "invalid")
              .when(F.col("cycle"), "cycle").when(~F.col("linked"), "no result").otherwise("ok"))
    return (placed.join(before.select("conv_id", "part", "before"), ["conv_id", "part"])
            .withColumn("position", F.col("before") + F.row_number().over(inside) - 1)
            .select("conv_id", "position", "turn", "call_id", "name", status.alias("status"), F.array_join("errors", "; ").alias("errors"), "record"))


TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query", "limit"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "after": {"type": "string"}}, "required": ["url"], "additionalProperties": False},
    "compute": {"type": "object", "properties": {"values": {"type": "array", "items": {"type": "number"}}, "precision": {"type": "integer"}}, "required": ["values"]},
}


def messages_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that follow from a chat: an assistant's turn calls a tool
    chosen by the length of its text, the next turn of another role answers it."""
    n, turn = F.coalesce(F.length("text"), F.lit(0)), F.col("turn").cast("string")
    name = F.when(n % 17 == 0, "unknown").otherwise(F.element_at(F.array(*map(F.lit, TOOLS)), n % 3 + 1))
    half = F.floor(F.col("turn") / 2)
    other = F.when(n % 13 == 0, F.col("turn") + 2).otherwise(half - 1 + half % 2).cast("string")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    search = F.concat(F.lit('{ "query": '), quoted(F.coalesce("text", F.lit(""))), F.lit(', "limit": '), F.when(n % 7 == 0, '"many"').otherwise((n % 50).cast("string")), F.lit("}"))
    fetch = F.concat(F.lit('{"url": "https://example.org/'), F.col("conv_id").cast("string"), F.lit("/"), turn, F.lit('", "after": "$result:call-'), other, F.lit('"}'))
    compute = F.concat(F.lit('{"precision" : '), (n % 4).cast("string"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(', "values": ['), n.cast("string"), F.lit(", 0.5]"))), F.lit(" }"))
    calls = conversations.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call-"), turn).alias("call_id"), name.alias("name"),
                                                             F.when(name == "search", search).when(name == "compute", compute).otherwise(fetch).alias("arguments"))
    results = conversations.where("role is null or role <> 'assistant'").select("conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def tools_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in TOOLS.items()], "name string, schema string")


SQL = r"""
with c0 as (select conv_id, turn, 'call-' || turn as call_id, text, coalesce(length(text), 0) as n, turn // 2 as half from conversations where role = 'assistant'),
c1 as (select *, case when n % 17 = 0 then 'unknown' else ['search', 'fetch', 'compute'][n % 3 + 1] end as name,
              case when n % 13 = 0 then turn + 2 else half - 1 + half % 2 end as other from c0),
c2 as (select *, case name
         when 'search' then case when n % 7 = 0 then json_object('limit', 'many', 'query', coalesce(text, '')) else json_object('limit', n % 50, 'query', coalesce(text, '')) end
         when 'compute' then case when n % 5 = 0 then json_object('precision', n % 4) else json_object('precision', n % 4, 'values', [n::double, 0.5]) end
         else json_object('after', '$result:call-' || other, 'url', 'https://example.org/' || conv_id || '/' || turn) end::varchar as args0,
         case when name in ('fetch', 'unknown') then 'call-' || other end as needs_id from c1),
c3 as (select * exclude (args0), case when name = 'compute' then replace(args0, '[' || n || '.0,', '[' || n || ',') else args0 end as args from c2),
e as (select a.conv_id, a.call_id, a.needs_id, b.call_id is null as missing, b.turn >= a.turn as forward
      from c3 a left join c3 b on a.conv_id = b.conv_id and a.needs_id = b.call_id where a.needs_id is not null),
f as (select distinct conv_id from e where forward),
l as (with recursive t(conv_id, call_id, lvl) as (
        select conv_id, call_id, 0 from c3 where conv_id in (select conv_id from f)
        union select e.conv_id, e.call_id, lvl + 1 from t join e on e.conv_id = t.conv_id and e.needs_id = t.call_id where not e.missing and lvl < 60)
      select conv_id, call_id, max(lvl) as lvl from t group by all),
r as (select conv_id, 'call-' || (turn - 1) as call_id, text as content from conversations where role is null or role <> 'assistant'),
j as (select c3.*, coalesce(l.lvl, 0) as lvl, r.call_id is not null as linked, r.content, coalesce(e.missing, false) as missing
      from c3 left join l using (conv_id, call_id) left join r using (conv_id, call_id) left join e using (conv_id, call_id))
select conv_id, row_number() over (partition by conv_id order by lvl >= 60, case when lvl >= 60 then 0 else lvl end, turn) - 1 as position, turn, call_id, name,
       case when name = 'unknown' then 'unknown tool' when missing or (name = 'search' and n % 7 = 0) or (name = 'compute' and n % 5 = 0) then 'invalid'
            when lvl >= 60 then 'cycle' when not linked then 'no result' else 'ok' end as status,
       concat_ws('; ', case when name = 'search' and n % 7 = 0 then '$.limit: not integer' when name = 'compute' and n % 5 = 0 then '$.values: missing' end,
                 case when missing then 'no call ' || needs_id end) as errors,
       '{"arguments":' || args || ',"id":' || to_json(call_id)::varchar || ',"name":' || to_json(name)::varchar
         || case when linked then ',"result":' || coalesce(to_json(content)::varchar, 'null') else '' end || '}' as record
from j
"""
