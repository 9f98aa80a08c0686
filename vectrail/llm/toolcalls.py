"""Tool calls of conversations, linked to their results, ordered, validated and serialised; DataFrame operations only.

Calls and results meet in a shuffled hash join on (conv_id, call_id), whose build side is the results by identifier. Identifiers spread a long conversation over all tasks,
and nothing is gathered by conversation: the topological order is given as a key, (order_turn, order_step), by which any
sort or range partitioning puts every call after all it depends on. order_turn is the latest turn of a call and all that
it depends on, order_step its place among those of that turn. A conversation whose calls only refer to earlier turns has
its turns as order and needs no iteration; in the others calls are peeled round by round (Kahn), and what is left when a
round finds nothing is a cycle (order null, error "cycle").

Arguments are validated against a JSON schema for each tool, compiled to columns: type, required, properties,
additionalProperties, enum, const, minimum, maximum, minLength, maxLength, pattern, minItems, maxItems. Canonical JSON
has sorted keys, no white space and plain numbers; it is one line a call, never one for a whole conversation.

Messages come in two forms, read together. A message that is a JSON object with `tool_calls` (role assistant) or
`tool_call_id` (role tool) is explicit: [{"id", "name" or "function": {"name", "arguments"}, "depends_on"}]. In ordinary
conversations every user turn calls the tool `answer` with its text as prompt, identified by its turn and depending on
the exchange before it, and an assistant turn is the result of the turn before it.

Defined cases: rows with a null conv_id or turn have no identifier and are left out; a null text makes a call without
prompt (invalid) or an empty result (null); a call without result is "unanswered", a result without call an "orphan"; of
calls with one identifier the first (turn, name, arguments) stands with the error "repeated call"; of several results the
first stands, and n_results counts them; a call without an identifier gets "?turn.place" and the error "no identifier",
and a tool message that names no call is the orphan "?turn"; arguments that are no JSON object have the error "arguments"; dependencies on
unknown calls have the error "unknown dependency" and are ignored in the order; long texts are passed on whole; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import as_long, checkpoint, read_table

ANSWER = {"answer": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}}, "required": ["prompt"], "additionalProperties": False}}
KEY = ["conv_id", "call_id"]
UNNAMED = r"^\?-?\d+\.\d+$"


def messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, turn, name, arguments, depends_on) of calls and (conv_id, call_id, turn, content) of results."""
    rows = conversations.select(as_long(conversations, "conv_id").alias("conv_id"), as_long(conversations, "turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("conv_id is not null and turn is not null")
    shaped = F.col("role").isin("assistant", "tool") & F.coalesce(F.ltrim("text").startswith("{"), F.lit(False))
    rows = rows.withColumn("v", F.when(shaped, F.try_parse_json("text")))
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    rows = rows.withColumns({"calls": F.when(F.col("role") == "assistant", get(F.col("v"), "$.tool_calls", "array<variant>")), "answers": F.when(F.col("role") == "tool", get(F.col("v"), "$.tool_call_id", "string"))})
    plain = rows.filter("calls is null and answers is null")
    told = rows.filter("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("place", "c"))
    c = F.col("c")
    inner = F.coalesce(get(c, "$.function.arguments", "variant"), get(c, "$.arguments", "variant"))
    told = told.select(
        "conv_id",
        F.coalesce(get(c, "$.id", "string"), F.concat(F.lit("?"), F.col("turn").cast("string"), F.lit("."), F.col("place").cast("string"))).alias("call_id"),
        "turn",
        F.coalesce(get(c, "$.function.name", "string"), get(c, "$.name", "string")).alias("name"),
        F.when(F.schema_of_variant(inner) == "STRING", F.variant_get(inner, "$", "string")).otherwise(F.to_json(inner)).alias("arguments"),
        F.coalesce(get(c, "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
    )
    ident = lambda turn: F.concat(F.lit("turn-"), turn.cast("string"))
    asked = plain.filter("role = 'user'").select(
        "conv_id",
        ident(F.col("turn")).alias("call_id"),
        "turn",
        F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    given = rows.filter("answers is not null").select("conv_id", F.col("answers").alias("call_id"), "turn", F.coalesce(get(F.col("v"), "$.content", "string"), F.to_json(get(F.col("v"), "$.content", "variant"))).alias("content"))
    said = plain.filter("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    lost = plain.filter("role = 'tool'").select("conv_id", F.concat(F.lit("?"), F.col("turn").cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return told.unionByName(asked), given.unionByName(said).unionByName(lost)


def _one_of(kind: Column, wanted: str) -> Column:
    return {
        "string": kind == "STRING",
        "integer": kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(r"^DECIMAL\(\d+,0\)$"),
        "number": kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
        "boolean": kind == "BOOLEAN",
        "object": kind.startswith("OBJECT"),
        "array": kind.startswith("ARRAY"),
        "null": kind == "VOID",
    }[wanted]


def _checks(value: Column, name: str, schema: dict) -> list[tuple[str, Column]]:
    """(error, condition that holds where the value breaks the schema); the conditions are never null."""
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    types = schema.get("type")
    out = []
    if types:
        types = [types] if isinstance(types, str) else types
        out.append((f"{name}: type", ~reduce(lambda a, b: a | b, [_one_of(kind, t) for t in types])))
    is_text, is_number = kind == "STRING", _one_of(kind, "number")
    if "enum" in schema or "const" in schema:
        allowed = [x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x) for x in schema.get("enum", [schema.get("const")])]
        out.append((f"{name}: enum", ~text.isin(allowed)))
    for key, here, test in (
        ("minLength", is_text, lambda x: F.length(text) < x),
        ("maxLength", is_text, lambda x: F.length(text) > x),
        ("pattern", is_text, lambda x: ~text.rlike(x)),
        ("minimum", is_number, lambda x: number < x),
        ("maximum", is_number, lambda x: number > x),
        ("minItems", kind.startswith("ARRAY"), lambda x: F.size(F.try_variant_get(value, "$", "array<variant>")) < x),
        ("maxItems", kind.startswith("ARRAY"), lambda x: F.size(F.try_variant_get(value, "$", "array<variant>")) > x),
    ):
        if key in schema:
            out.append((f"{name}: {key}", here & test(schema[key])))
    if "properties" in schema or "required" in schema or schema.get("additionalProperties") is False:
        is_object = kind.startswith("OBJECT")
        for key, inner in schema.get("properties", {}).items():
            got = F.try_variant_get(value, f"$['{key}']", "variant")
            out += [(e, is_object & got.isNotNull() & c) for e, c in _checks(got, key if name == "arguments" else f"{name}.{key}", inner)]
        out += [(f"{key if name == 'arguments' else f'{name}.{key}'}: required", is_object & F.try_variant_get(value, f"$['{key}']", "variant").isNull()) for key in schema.get("required", [])]
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys(F.to_json(value)), F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>"))
            out.append((f"{name}: additional", is_object & (F.size(extra) > 0)))
    return [(e, F.coalesce(c, F.lit(False))) for e, c in out]


def errors_of(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Sorted schema errors of a call, as an array."""
    known = F.coalesce(name.isin(list(schemas)), F.lit(False))
    shape = F.coalesce(~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(True))
    found = [F.when(~known, F.lit("unknown tool")), F.when(shape, F.lit("arguments"))]
    for tool, schema in schemas.items():
        mine = F.coalesce(name == tool, F.lit(False)) & ~shape
        found += [F.when(mine & bad, F.lit(e)) for e, bad in _checks(arguments, "arguments", schema)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def topological_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, order_turn, order_step, missing) of distinct calls; order is null in a cycle."""
    nodes = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("depends_on")).alias("dep"))
    target = nodes.select("conv_id", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"))
    edges = edges.join(target.hint("shuffle_hash"), ["conv_id", "dep"], "left")
    missing = edges.filter("dep_turn is null").select(*KEY).distinct().withColumn("missing", F.lit(True))
    edges = edges.filter("dep_turn is not null")
    back = edges.filter("dep_turn >= turn")
    plain = nodes.select(*KEY, F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_step"))
    if not back.limit(1).count():
        done = plain
    else:
        odd = checkpoint(back.select("conv_id").distinct())
        links = checkpoint(edges.join(odd, "conv_id", "left_semi").select(*KEY, "dep"))
        wait = checkpoint(nodes.join(odd, "conv_id", "left_semi").join(links.groupBy(*KEY).agg(F.count("*").alias("open")), KEY, "left"))
        ready = checkpoint(wait.filter("open is null").select(*KEY, F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("s")).alias("at")))
        finished = ready
        while ready.limit(1).count():
            step = links.join(ready.select("conv_id", F.col("call_id").alias("dep"), "at"), ["conv_id", "dep"])
            step = step.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.struct(F.col("at.t").alias("t"), (F.col("at.s") + 1).alias("s"))).alias("seen"))
            own = F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("s"))
            wait = wait.join(step, KEY, "left")
            seen = F.when(F.col("seen").isNull(), F.col("best") if "best" in wait.columns else own)
            best = F.greatest(F.coalesce(seen, F.col("seen")), F.col("best") if "best" in wait.columns else own)
            wait = checkpoint(wait.filter("open is not null").select(*KEY, "turn", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), best.alias("best")))
            ready = checkpoint(wait.filter("open = 0").select(*KEY, F.col("best").alias("at")))
            wait = wait.filter("open > 0")
            finished = checkpoint(finished.unionByName(ready))
        peeled = finished.select(*KEY, F.col("at.t").alias("order_turn"), F.col("at.s").alias("order_step"))
        rest = nodes.join(odd, "conv_id", "left_semi").select(*KEY).join(peeled, KEY, "left")
        done = plain.join(odd, "conv_id", "left_anti").unionByName(rest)
    return done.join(missing, KEY, "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call or orphan result: conv_id, call_id, status, call_turn, result_turn, n_results, order_turn,
    order_step, valid, errors and json."""
    first = F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("first")
    one = calls.groupBy(*KEY).agg(first, F.count("*").alias("n_calls")).select(*KEY, "first.*", "n_calls")
    got = results.groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    got = got.select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    both = one.join(topological_keys(one).hint("shuffle_hash"), KEY).join(got.hint("shuffle_hash"), KEY, "full_outer")
    is_call = F.col("turn").isNotNull()
    both = both.withColumn("args", F.try_parse_json("arguments"))
    more = [F.when(F.col("call_id").rlike(UNNAMED), F.lit("no identifier")), F.when(F.col("n_calls") > 1, F.lit("repeated call")), F.when(F.col("missing"), F.lit("unknown dependency")), F.when(F.col("order_turn").isNull(), F.lit("cycle"))]
    errors = F.when(is_call, F.array_sort(F.concat(errors_of(F.col("name"), F.col("args"), schemas), F.array_compact(F.array(*more))))).otherwise(F.array(F.lit("no call")))
    both = both.withColumn("errs", errors)
    status = F.when(~is_call, "orphan").when(F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    body = F.struct(F.coalesce("args", F.parse_json(F.lit("null"))).alias("arguments"), "call_id", "conv_id", F.col("errs").alias("errors"), "name", F.col("content").alias("result"))
    return both.select(
        *KEY,
        status.alias("status"),
        F.col("turn").alias("call_turn"),
        "result_turn",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "order_turn",
        "order_step",
        (F.size("errs") == 0).alias("valid"),
        F.array_join("errs", ",").alias("errors"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("json"),
    )


def op8_tool_call_linking(spark, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked."""
    calls, results = messages(read_table(spark, sf_dir, "conversations"))
    return link(calls, results, ANSWER)


ORACLE = """
WITH calls AS (
  SELECT conv_id, 'turn-' || CAST(turn AS VARCHAR) AS call_id, turn, text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), results AS (
  SELECT conv_id, 'turn-' || CAST(turn - 1 AS VARCHAR) AS call_id, turn, text FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn, c.text AS prompt, r.text AS content,
    CASE WHEN c.turn IS NULL THEN 'no call' WHEN length(c.text) < 1 THEN 'prompt: minLength' WHEN length(c.text) > 400 THEN 'prompt: maxLength' ELSE '' END AS own_errors,
    CASE WHEN c.turn >= 2 AND p.turn IS NULL THEN 'unknown dependency' ELSE '' END AS dep_errors
  FROM calls c FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
  LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
), told AS (
  SELECT *, own_errors || CASE WHEN own_errors <> '' AND dep_errors <> '' THEN ',' ELSE '' END || dep_errors AS errors FROM linked
)
SELECT conv_id, call_id,
  CASE WHEN call_turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  call_turn, result_turn, CAST(CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
  call_turn AS order_turn, CASE WHEN call_turn IS NULL THEN NULL ELSE CAST(0 AS BIGINT) END AS order_step,
  errors = '' AS valid, errors,
  '{"arguments":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || '}' END
    || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"conv_id":' || CAST(conv_id AS VARCHAR)
    || ',"errors":' || CASE WHEN errors = '' THEN '[]' ELSE CAST(to_json(string_split(errors, ',')) AS VARCHAR) END
    || ',"name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"answer"' END
    || ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}' AS json
FROM told
"""
