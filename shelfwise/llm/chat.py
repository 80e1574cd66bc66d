"""Tool-call linking in DataFrame operations only.

Calls and results are hash-joined by identifier, messages are put in an order in which no result precedes its call,
arguments are checked against schemas, and each message becomes canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

#: Turns that one window holds; long conversations are numbered bucket by bucket.
BUCKET = 1024
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^OBJECT.*"}


def messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages with calls and results.

    A user turn calls the tool `reply` with its text and turn; an assistant turn gives the result of the call of
    the turn before it. Other turns are plain messages.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    identifier = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return c.select(
        "*",
        F.when(known & (F.col("role") == "user"), identifier(F.col("turn"))).alias("call_id"),
        F.when(known & (F.col("role") == "user"), "reply").alias("name"),
        F.when(known & (F.col("role") == "user"), F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))).alias("arguments"),
        F.when(known & (F.col("role") == "assistant"), identifier(F.col("turn") - 1)).alias("result_of"),
    )


def schemas(spark: SparkSession) -> DataFrame:
    """The fields of the tools that the conversations call."""
    return spark.createDataFrame([("reply", "prompt", "string", True), ("reply", "turn", "integer", True)], "name string, field string, type string, required boolean")


#: Fields of all tools up to which their rows are broadcast.
MOST_FIELDS = 100_000


def check_arguments(calls: DataFrame, schema: DataFrame, valid: str = "valid") -> DataFrame:
    """calls(name, arguments, ...) with a column valid: an object that has all required fields, and known fields of their types only.

    Each row is judged by itself. A tool without a schema, and arguments that are no object or repeat a key, are not
    valid. Of schema rows that repeat a field, the first type in order counts, and it is required if any says so; rows
    without a tool or a field do not count.
    """
    schema = schema.filter("name is not null and field is not null").groupBy("name", "field").agg(F.min("type").alias("type"), F.max("required").alias("required"))
    # A row for each tool: a schema is small, and the tools are few beside the calls.
    tools = schema.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("_types"), F.collect_list(F.when(F.col("required"), F.col("field"))).alias("_required"))
    small = schema.limit(MOST_FIELDS + 1).count() <= MOST_FIELDS
    parsed = calls.withColumn("_fields", F.from_json("arguments", "map<string,variant>")).join(F.broadcast(tools) if small else tools, "name", "left")

    def fits(k, v):
        shape, wanted = F.schema_of_variant(v), F.element_at("_types", k)
        out = F.lit(False)
        for kind, pattern in TYPES.items():
            out = F.when(wanted == kind, shape.rlike(pattern)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    whole = F.size(F.array_except("_required", F.map_keys("_fields"))) == 0
    known = F.forall(F.map_entries("_fields"), lambda e: fits(e["key"], e["value"]))
    held = F.coalesce(F.col("_types").isNotNull() & F.col("_fields").isNotNull() & F.try_parse_json("arguments").isNotNull() & whole & known, F.lit(False))
    return parsed.select(*[c for c in calls.columns if c != valid], held.alias(valid))


def canonical(arguments):
    """JSON with sorted keys and without spaces; what is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(arguments)), arguments)


def call_order(calls: DataFrame) -> DataFrame:
    """call_id, call_rank, call_depth of calls(call_id, turn, parent): the greatest turn on the way to the call that
    no other calls for, and the number of calls on it.

    parent is the call whose result made this call. Ways are doubled each round, so a chain of n calls takes log n
    rounds; where a round settles no call, those left lie on circles or behind them and keep their own turn.
    """
    known = calls.select(F.col("call_id").alias("parent"), F.lit(True).alias("known"))
    # most calls have no parent: only those that have one are joined, so that nothing meets at null
    state = lambda df, up, depth: df.select("call_id", "turn", up.alias("up"), F.col("turn").alias("rank"), depth.alias("depth"))
    chained = calls.filter("parent is not null").join(known.hint("shuffle_hash"), "parent", "left")
    chained = state(chained, F.when(F.col("known"), F.col("parent")), F.when(F.col("known"), 1).otherwise(0))
    ways, before = materialise(state(calls.filter("parent is null"), F.lit(None).cast("string"), F.lit(0)).union(chained), "calls"), None
    while (left := ways.filter("up is not null").count()) and left != before:
        above = ways.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("rank").alias("r"), F.col("depth").alias("d"))
        open_ = ways.filter("up is not null").join(above.hint("shuffle_hash"), "up", "left").select(
            "call_id", "turn", F.col("next").alias("up"), F.greatest("rank", "r").alias("rank"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth")
        )
        ways, before = materialise(ways.filter("up is null").union(open_), "calls"), left
    round_ = F.col("up").isNotNull()
    return ways.select("call_id", F.when(round_, F.col("turn")).otherwise(F.col("rank")).alias("call_rank"), F.when(round_, 0).otherwise(F.col("depth")).alias("call_depth"))


def link_tool_calls(turns: DataFrame, schema: DataFrame) -> DataFrame:
    """conv_id, turn, position, role, call_id, linked, valid, message of every row of turns.

    turns: conv_id, turn, role, text, call_id, name, arguments (JSON), result_of. A message may be a result and a
    call at once. position counts a conversation's messages from 0 in topological order: by turn, but a result never
    before its call, along whole chains; equal turns by role and text. call_id: of a result its call's, else its own.
    linked: a result with a call, or a call with a result. valid: of calls, whether their own arguments fit the schema.
    message: canonical JSON, its arguments too. Null conversations count as one; null turns come last; identifiers
    that repeat link by their first turn; an empty table gives none. Other columns are not read.
    """
    called = turns.filter("call_id is not null")
    first = called.groupBy("call_id").agg(F.min(F.struct("turn", "result_of")).alias("f")).select("call_id", "f.turn", F.col("f.result_of").alias("parent"))
    order = call_order(first)
    results = turns.filter("result_of is not null").groupBy("result_of").agg(F.count("*").alias("n_results"))
    # 0, but no constant, which the optimiser would take out of the keys
    zero = lambda key: (F.length(key) * 0).alias("_spread")
    answered = results.select(F.col("result_of").alias("call_id"), "n_results", zero("result_of"))
    order = order.select(F.col("call_id").alias("result_of"), "call_rank", "call_depth", zero("call_id"))
    turns = check_arguments(turns.select("conv_id", "turn", "role", "text", "call_id", "name", "arguments", "result_of"), schema, "_valid")
    # messages without an identifier match nothing, and are dealt by what they are instead of meeting in one task
    spread = lambda key: F.when(F.col(key).isNotNull(), 0).otherwise(F.hash("conv_id", "turn", "text"))
    linked = turns.withColumn("_spread", spread("result_of")).join(order.hint("shuffle_hash"), ["result_of", "_spread"], "left")
    linked = linked.withColumn("_spread", spread("call_id")).join(answered.hint("shuffle_hash"), ["call_id", "_spread"], "left")
    is_result = F.col("result_of").isNotNull()
    linked = linked.withColumn("linked", F.when(is_result, F.col("call_depth").isNotNull()).when(F.col("call_id").isNotNull(), F.col("n_results").isNotNull()))
    linked = linked.withColumn("_rank", F.coalesce(F.greatest("turn", "call_rank"), F.lit(2**62))).withColumn("_depth", F.coalesce(F.col("call_depth") + 1, F.lit(0)))
    linked = linked.withColumn("_bucket", F.expr(f"_rank div {BUCKET}"))
    counts = linked.groupBy("conv_id", "_bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("conv_id", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("l.conv_id", "l._bucket").orderBy("_rank", "_depth", "turn", "role", "text")
    same = F.col("l.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("l._bucket") == F.col("b._bucket"))
    placed = linked.alias("l").join(base.alias("b").hint("shuffle_hash"), same).withColumn("position", F.col("_base") + F.row_number().over(within) - 1)
    call = F.struct(canonical(F.col("arguments")).alias("arguments"), F.col("call_id").alias("id"), F.col("name"))
    answers = F.col("linked") & F.col("result_of").isNotNull()
    message = F.struct(
        F.col("text").alias("content"),
        F.when(answers, "tool").otherwise(F.col("role")).alias("role"),
        F.when(answers, F.col("result_of")).alias("tool_call_id"),
        F.when(F.col("call_id").isNotNull(), F.array(call)).alias("tool_calls"),
    )
    return placed.select(
        "l.conv_id", "turn", "position", "role", F.coalesce("result_of", "call_id").alias("call_id"), "linked",
        F.when(F.col("call_id").isNotNull(), F.col("_valid")).alias("valid"), F.to_json(message).alias("message"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role = 'user' THEN 'call-' || conv_id || '-' || turn WHEN role = 'assistant' THEN 'call-' || conv_id || '-' || (turn - 1) END AS call_id
  FROM conversations),
l AS (
  SELECT t.*, CASE WHEN call_id IS NOT NULL THEN
    call_id IN (SELECT call_id FROM t WHERE role = 'user') AND call_id IN (SELECT call_id FROM t WHERE role = 'assistant') END AS linked FROM t)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, role, call_id, linked,
  CASE WHEN role = 'user' THEN text IS NOT NULL END AS valid,
  CASE WHEN role = 'user' THEN CAST(json_object('content', text, 'role', role, 'tool_calls',
      [json_object('arguments', CAST(json_object('prompt', text, 'turn', turn) AS VARCHAR), 'id', call_id, 'name', 'reply')]) AS VARCHAR)
    WHEN linked THEN CAST(json_object('content', text, 'role', 'tool', 'tool_call_id', call_id) AS VARCHAR)
    ELSE CAST(json_object('content', text, 'role', role) AS VARCHAR) END AS message
FROM l
"""
