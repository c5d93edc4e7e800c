"""Chat formatting: tool calls are linked to their results, put in topological order, validated and written as canonical JSON.

Calls and results are hash-joined by (conversation, identifier). A call's level is one more than the highest level of the
calls it depends on; chains of calls are followed by pointers that double each round, and only calls with several needs take
rounds of their own. Arguments are parsed once and held against the schema of their tool. Canonical JSON has sorted keys and
no white space. One row is one link, so that no conversation, however long, is gathered in one place. All of it is built
from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: The tools that turns of a conversation stand for: name, property, JSON type, whether it must be there.
TURN_SCHEMAS = (
    ("system", "text", "string", True), ("system", "turn", "integer", True),
    ("user", "text", "string", True), ("user", "turn", "integer", True),
)
_CALLS = "tool_calls array<struct<id string, name string, arguments string, depends_on array<string>>>"
_RESULT = "tool_call_id string, content string"


def json_type(value: Column) -> Column:
    """The JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isNull(), None).when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def schema_table(spark: SparkSession, rows=TURN_SCHEMAS) -> DataFrame:
    return spark.createDataFrame(list(rows), "name string, property string, type string, required boolean")


def problems(schema: Column) -> Column:
    """What is wrong with ``fields``, the arguments by name, in the schema's order; schema: array of (property, type, required), null if the tool is unknown."""

    def wrong(p: Column) -> Column:
        have = json_type(F.try_element_at(F.col("fields"), p["property"]))
        absent = have.isNull() | (have == "null")
        fits = (have == p["type"]) | ((p["type"] == "number") & (have == "integer"))
        return F.when(absent & p["required"], F.concat(F.lit("missing "), p["property"])).when(~absent & ~fits, F.concat(p["property"], F.lit(" is no "), p["type"]))

    extra = F.array_except(F.map_keys("fields"), F.transform(schema, lambda p: p["property"]))
    listed = F.concat(F.filter(F.transform(schema, wrong), lambda x: x.isNotNull()), F.transform(F.array_sort(extra), lambda x: F.concat(F.lit("unknown "), x)))
    return F.when(F.col("fields").isNull(), F.array(F.lit("arguments are no JSON object"))).when(schema.isNull(), F.array(F.lit("unknown tool"))).otherwise(listed)


def chains(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, root, far) for calls with one need each: the first call up the chain that has none or several, and how far up.

    Pointers double in each round, so a chain of n calls takes log n rounds; calls on a cycle never reach a root and fall away.
    """
    keys = ["conv_id", "call_id"]
    single = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("needs").alias("root")).filter("n = 1").select(*keys, "root", F.lit(1).alias("far"))
    open_, done, left = written(single, "chain"), None, None
    while True:
        up = open_.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("far").alias("more"))
        if done is not None:
            up = up.union(done.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("far").alias("more")))
        jumped = open_.join(up, ["conv_id", "root"], "left")
        now = written(jumped.select(*keys, F.coalesce("next", "root").alias("root"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNull().alias("rests")), "chain")
        rested = now.filter("rests").drop("rests")
        done = rested if done is None else written(done.union(rested), "chain")
        open_ = now.filter("not rests").drop("rests")
        n = open_.count()
        if n == 0 or n == left and rested.isEmpty():
            # Distances on a cycle grow for ever; a round in which nothing comes to rest leaves cycles and what hangs on them.
            return done
        left = n


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all calls that hang on no cycle; edges: (conv_id, call_id, needs), all of them calls.

    Chains are followed at once; then a round for each call with several needs on the longest way.
    """
    keys = ["conv_id", "call_id"]
    chain = chains(edges)
    waits = edges.groupBy(*keys).agg(F.count("*").alias("waits"))
    several = written(waits.filter("waits > 1"), "waits")
    # The needs of calls with several, each as a root, which has a level of its own, and the way down from it.
    needs = edges.join(several.select(*keys), keys, "left_semi").join(chain.select("conv_id", F.col("call_id").alias("needs"), "root", "far"), ["conv_id", "needs"], "left")
    needs = written(needs.select(*keys, F.coalesce("root", "needs").alias("root"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "needs")
    done = written(calls.join(waits, keys, "left_anti").select(*keys, F.lit(0).alias("level")), "level")
    frontier, met = done, None
    while not several.isEmpty():
        now = needs.join(frontier.select("conv_id", F.col("call_id").alias("root"), "level"), ["conv_id", "root"]).groupBy(*keys).agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("far")).alias("level"))
        met = now if met is None else met.union(now).groupBy(*keys).agg(F.sum("met").alias("met"), F.max("level").alias("level"))
        met = written(met, "met")
        ready = met.join(several, keys).filter("met = waits")
        frontier = written(ready.select(*keys, "level"), "level")
        if frontier.isEmpty():
            break
        met = met.join(frontier.select(*keys), keys, "left_anti")
        done = done.union(frontier)
    roots = done.select("conv_id", F.col("call_id").alias("root"), F.col("level").alias("base"))
    return done.union(chain.join(roots, ["conv_id", "root"]).select(*keys, (F.col("base") + F.col("far")).alias("level")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each link of a result to its call, each call without a result, and each result without a call.

    calls: conv_id, call_id, name, turn, arguments (JSON text), depends_on (array of call_ids); results: conv_id, call_id,
    turn, content; schemas: name, property, type, required. Gives conv_id, call_id, name, level, turn, result_turn, valid,
    problems (joined by "; ") and json.

    Calls that share an identifier count as one, the first by turn, name and arguments; every result with the identifier
    links to it, so repeated results give repeated rows. Rows without an identifier link with nothing. What a call depends on
    counts if it is a call of the same conversation; calls on a cycle, or behind one, have no level and the problem "cycle".
    A result without a call has no name, level or validity. Order a conversation by level, turn, call_id, result_turn.
    """
    keys = ["conv_id", "call_id"]
    named = calls.filter("conv_id is not null and call_id is not null")
    one = named.groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c")).select(*keys, "c.*")
    loose = calls.filter("conv_id is null or call_id is null").select(*keys, "turn", "name", "arguments", F.array().cast("array<string>").alias("depends_on"))
    one = written(one.union(loose), "calls")
    ids = one.filter("conv_id is not null and call_id is not null").select(*keys)
    declared = one.filter("conv_id is not null and call_id is not null").select(*keys, F.explode(F.array_distinct("depends_on")).alias("needs"))
    edges = written(declared.join(ids.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"]).select(*keys, "needs"), "edges")
    placed = levels(ids, edges)
    known = edges.groupBy(*keys).agg(F.sort_array(F.collect_list("needs")).alias("known"))  # no longer than the call's own list

    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("property", "type", "required"))).alias("schema"))
    full = one.drop("depends_on").join(placed, keys, "left").join(known, keys, "left").join(tools, "name", "left")
    full = full.withColumn("args", F.try_parse_json("arguments")).withColumn("fields", F.expr("try_cast(args as map<string, variant>)"))
    cycle = F.when(F.col("level").isNull() & F.col("call_id").isNotNull() & F.col("conv_id").isNotNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    full = full.withColumn("problems", F.concat(problems(F.col("schema")), cycle))
    full = full.select(*keys, F.struct("name", "level", "turn", "args", "problems", F.coalesce("known", F.array().cast("array<string>")).alias("depends_on")).alias("call"))
    told = results.select(*keys, F.struct("turn", "content").alias("result"))
    joined = full.join(told, keys, "full_outer")
    shape = F.struct(
        F.col("call.args").alias("arguments"), F.col("call.depends_on").alias("depends_on"), F.col("call_id").alias("id"), F.col("call.name").alias("name"), F.when(F.col("result").isNotNull(), F.struct(F.col("result.content").alias("content"), F.col("result.turn").alias("turn"))).alias("result")
    )
    return joined.select(
        *keys, "call.name", "call.level", "call.turn", F.col("result.turn").alias("result_turn"), (F.size("call.problems") == 0).alias("valid"), F.array_join("call.problems", "; ").alias("problems"), F.to_json(shape, {"ignoreNullFields": "false"}).alias("json")
    )


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of turns (conv_id, turn, role, text).

    An assistant's or tool's turn is the result of the turn before it; every other turn is a call named by its role, whose
    arguments are its number and text, and which depends on the two turns before it. A text that is a JSON object with
    tool_calls, or with a tool_call_id, also gives the calls, or is the result, that it names.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("none")).alias("role"), F.col("text").cast("string").alias("text"))
    answer = F.col("role").isin("assistant", "tool")
    ident = lambda back: F.concat(F.lit("turn-"), (F.col("turn") - back).cast("string"))
    calls = rows.filter(~answer).select(
        "conv_id", ident(0).alias("call_id"), F.col("role").alias("name"), "turn", F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"}).alias("arguments"), F.filter(F.array(ident(1), ident(2)), lambda x: x.isNotNull()).alias("depends_on")
    )
    said = rows.filter(answer & F.ltrim("text").startswith("{"))
    inner = said.select("conv_id", "turn", F.explode(F.from_json("text", _CALLS)["tool_calls"]).alias("c"))
    inner = inner.select("conv_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), "turn", F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    read = F.when(F.ltrim("text").startswith("{"), F.from_json("text", _RESULT))
    results = rows.filter(answer).withColumn("read", read).select("conv_id", F.coalesce("read.tool_call_id", ident(1)).alias("call_id"), "turn", F.when(F.col("read.tool_call_id").isNotNull(), F.col("read.content")).otherwise(F.col("text")).alias("content"))
    return calls.union(inner), results


def op6_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, schema_table(spark))


OP6_SQL = """
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'none') AS role, text FROM conversations),
calls AS (SELECT conv_id, 'turn-' || turn AS call_id, min({'turn': turn, 'name': role, 'text': text}) AS c
          FROM rows WHERE role NOT IN ('assistant', 'tool') GROUP BY ALL),
needs AS (SELECT a.conv_id, a.call_id, b.call_id AS needs
          FROM calls a JOIN calls b ON a.conv_id = b.conv_id AND b.c.turn IN (a.c.turn - 1, a.c.turn - 2)),
paths AS (
  WITH RECURSIVE walk(conv_id, call_id, level) AS (
    SELECT conv_id, call_id, 0 FROM calls
    UNION ALL
    SELECT n.conv_id, n.call_id, w.level + 1 FROM walk w JOIN needs n ON n.conv_id = w.conv_id AND n.needs = w.call_id)
  SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY ALL),
known AS (SELECT conv_id, call_id, list_sort(list(needs)) AS depends_on FROM needs GROUP BY ALL),
results AS (SELECT conv_id, 'turn-' || (turn - 1) AS call_id, turn, text FROM rows WHERE role IN ('assistant', 'tool')),
joined AS (
  SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.call_id, r.call_id) AS call_id, a.c, p.level,
         CASE WHEN a.call_id IS NOT NULL THEN coalesce(k.depends_on, []) END AS depends_on, r.turn AS result_turn, r.text AS content, r.call_id AS linked
  FROM calls a LEFT JOIN paths p USING (conv_id, call_id) LEFT JOIN known k USING (conv_id, call_id)
  FULL JOIN results r ON a.conv_id = r.conv_id AND a.call_id = r.call_id),
judged AS (
  SELECT *, CASE WHEN c IS NULL THEN NULL WHEN c.name NOT IN ('system', 'user') THEN 'unknown tool' WHEN c.text IS NULL THEN 'missing text' ELSE '' END AS problems FROM joined)
SELECT conv_id, call_id, c.name AS name, CAST(level AS INTEGER) AS level, c.turn AS turn, result_turn, problems = '' AS valid, problems,
       CAST(json_object('arguments', CASE WHEN c IS NULL THEN NULL ELSE json_object('text', c.text, 'turn', c.turn) END, 'depends_on', depends_on, 'id', call_id, 'name', c.name,
         'result', CASE WHEN linked IS NULL THEN NULL ELSE json_object('content', content, 'turn', result_turn) END) AS VARCHAR) AS json
FROM judged
"""
