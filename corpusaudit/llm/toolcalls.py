"""Tool-call linking for chat data, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.plans.shapes import checkpoint

from .sharding import with_slot


def canonical(json: F.Column) -> F.Column:
    """JSON text with sorted keys and no white space; null where the text is not JSON."""
    return F.to_json(F.try_parse_json(json))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_row, errors): every way in which a call's arguments miss its tool's schema, sorted.

    ``schemas`` has tool, field, type (a name of ``schema_of_variant``, such as STRING or BIGINT) and required. Errors: ``not an object``,
    ``unknown tool``, ``missing f``, ``unknown f``, ``f is not T``.
    """
    parsed = calls.select("call_row", "tool", F.try_parse_json("arguments").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False))
    shape = parsed.select("call_row", "tool", is_object.alias("is_object"))
    parsed.filter(is_object).createOrReplaceTempView("_parsed_arguments")
    given = calls.sparkSession.sql("SELECT call_row, tool, key AS field, schema_of_variant(value) AS kind FROM _parsed_arguments, LATERAL variant_explode(v)")
    tools = schemas.select("tool").distinct()
    known = shape.join(tools.withColumn("is_known", F.lit(True)), "tool", "left")
    plain = known.select("call_row", F.when(~F.col("is_object"), "not an object").when(F.col("is_known").isNull(), "unknown tool").alias("error")).filter("error is not null")
    checked = known.filter("is_object and is_known").select("call_row", "tool")
    wanted = checked.join(schemas, "tool").select("call_row", "field", "type", "required")
    have = given.join(tools, "tool", "left_semi").select("call_row", "field", "kind")
    fields = wanted.join(have, ["call_row", "field"], "full").select(
        "call_row", F.when(F.col("type").isNull(), F.concat(F.lit("unknown "), "field"))
        .when(F.col("kind").isNull() & F.col("required"), F.concat(F.lit("missing "), "field"))
        .when(F.col("kind") != F.col("type"), F.concat("field", F.lit(" is not "), "type")).alias("error")).filter("error is not null")
    return plain.unionByName(fields).groupBy("call_row").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def depths(calls: DataFrame) -> DataFrame:
    """(call_row, depth) by pointer jumping: 0 for calls that wait for none, else one more than the call
    waited for. Calls on a cycle, and those that wait for them, have none. Rounds grow with the logarithm of the longest chain."""
    ids = calls.groupBy("call_id").agg(F.min("call_row").alias("up")).filter("call_id is not null")
    at = checkpoint(calls.select("call_row", F.col("after").alias("call_id")).join(ids, "call_id", "left").select("call_row", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    total, hops = at.count(), 1
    while hops <= total and not at.filter("up is not null").isEmpty():
        above = at.select(F.col("call_row").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        at = checkpoint(at.join(above, "up", "left").select("call_row", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        hops *= 2
    return at.select("call_row", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link tool calls to results, order them, validate their arguments and serialise each as canonical JSON.

    ``calls``: conv_id, turn, call_id, after (a call it waits for, or null), tool, arguments (JSON text). ``results``: call_id,
    turn, content. Returns one row per call: conv_id, position (from 0 within the conversation, in topological order:
    depth, then turn; calls on a cycle last), turn, call_id, tool, depth, status, errors, n_results, message.
    ``status``: ``ok``, ``invalid`` (errors), ``unanswered`` (no result) or ``cyclic``, the worst of them. A call's result is the one of the first
    turn; ``n_results`` counts all. Results without a call go; null ids link to nothing; calls that share an id share its results, and ``after``
    means the first of them. Null or broken arguments are ``not an object`` and serialise as null. Other columns play no part.
    """
    spark = calls.sparkSession
    own = checkpoint(calls.select("conv_id", "turn", "call_id", "after", "tool", "arguments").withColumn("call_row", F.monotonically_increasing_id()))
    # Results meet per identifier before the join, so that each identifier has one row; only first turn and count are kept.
    answers = results.filter("call_id is not null").groupBy("call_id").agg(
        F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
    linked = own.join(answers, "call_id", "left")
    judged = linked.join(argument_errors(own, schemas), "call_row", "left").join(depths(own), "call_row", "left")
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    status = (F.when(F.col("depth").isNull(), "cyclic").when(F.size(errors) > 0, "invalid").when(F.col("n_results").isNull(), "unanswered").otherwise("ok"))
    rows = judged.select(
        "conv_id", "turn", "call_id", "tool", "depth", status.alias("status"), errors.alias("errors"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce("depth", F.lit((1 << 62))).alias("_rank"), F.to_json(F.struct("call_id", F.col("first.content").alias("result"), "tool"), {"ignoreNullFields": "false"}).alias("_rest"),
        F.coalesce(canonical(F.col("arguments")), F.lit("null")).alias("_arguments"))
    # Keys in order: arguments, call_id, result, tool.
    message = F.concat(F.lit('{"arguments":'), F.col("_arguments"), F.lit(","), F.substring("_rest", 2, 2147483647))
    out = with_slot(rows.withColumn("message", message).drop("_rest", "_arguments"), "conv_id", ["_rank", "turn", "call_id", "message"], "position")
    return out.select("conv_id", "position", "turn", "call_id", "tool", "depth", "status", "errors", "n_results", "message")
