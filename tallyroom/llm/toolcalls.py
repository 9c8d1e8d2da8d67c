"""Tool-call linking for chat formatting, natively.

Calls and results are joined by identifier. Calls are ordered topologically: a call comes after the
calls whose results its arguments use. Arguments are checked against the tool's schema and written as
canonical JSON (keys in order, no blanks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm import common

TURNS = 256


def canonical(arguments: F.Column) -> F.Column:
    """Canonical JSON of a JSON text, or null if it is no JSON: variants keep their keys in order."""
    return F.to_json(F.try_parse_json(arguments))


def _kind(value: F.Column) -> F.Column:
    """JSON type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.isin("BIGINT", "TINYINT", "SMALLINT", "INT"), F.lit("integer"))
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.lit("number"))
        .when(kind == "STRING", F.lit("string"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .when(kind.startswith("OBJECT"), F.lit("object"))
        .when(kind.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("null"))
    )


def levels(edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_key, level) of calls by longest path over edges (before, after), both call keys.

    Level 0 has no edge in. Each round releases the calls all of whose predecessors have a level, until none is
    released, so there are as many rounds as levels. Calls on or behind a cycle get no row.
    """
    edges = common.stored(edges.distinct(), "tc-edges")
    need = edges.groupBy(F.col("after").alias("call_key")).agg(F.count("*").alias("need"))
    waiting = common.stored(calls.select("call_key").distinct().join(need, "call_key", "left").fillna(0, ["need"]), "tc-need")
    front = common.stored(waiting.filter("need = 0").select("call_key", F.lit(0).alias("level")), "tc-front")
    waiting = waiting.filter("need > 0")
    done, level = front, 0
    while not front.isEmpty():
        level += 1
        # a call waits for as many more results as its predecessors of this round leave it
        met = edges.join(front.select(F.col("call_key").alias("before")), "before").groupBy(F.col("after").alias("call_key")).agg(F.count("*").alias("met"))
        left = waiting.join(met, "call_key", "left").select("call_key", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"))
        left = common.stored(left, "tc-waiting")
        front = left.filter("need = 0").select("call_key", F.lit(level).alias("level"))
        waiting = left.filter("need > 0")
        done = done.unionAll(front)
        if level % 16 == 0:  # a plan of few files, however many levels there are
            done = common.stored(done, "tc-done")
    return done


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with arguments parsed and ``problems``: missing, mistyped or unknown fields, in order of their names.

    ``schemas`` has a row (name, field, kind, required) for each field of a tool: kind is string, integer,
    number (an integer is one too), boolean, object or array.
    """
    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("field", "kind", "required"))).alias("fields"))
    out = calls.join(tools, "name", "left").withColumn("_args", F.try_parse_json("arguments"))
    out = out.withColumn("_canonical", F.to_json("_args"))
    is_object = F.coalesce(F.schema_of_variant("_args").startswith("OBJECT"), F.lit(False))
    values = F.when(is_object, F.try_variant_get("_args", "$", "map<string,variant>"))
    out = out.withColumn("_values", values)
    out = out.withColumn("_kinds", F.transform_values("_values", lambda k, v: _kind(v)))
    known = F.transform("fields", lambda f: f["field"])

    def field_problem(f):
        kind = F.try_element_at("_kinds", f["field"])
        fits = (kind == f["kind"]) | ((f["kind"] == "number") & (kind == "integer"))
        missing = F.when(kind.isNull() & f["required"], F.concat(F.lit("missing "), f["field"]))
        return F.coalesce(missing, F.when(kind.isNotNull() & ~fits, F.concat(F.lit("mistyped "), f["field"])))

    unknown = F.transform(F.filter(F.map_keys("_kinds"), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit("unknown "), k))
    found = F.sort_array(F.concat(F.filter(F.transform("fields", field_problem), lambda p: p.isNotNull()), unknown))
    problems = (
        F.when(F.col("fields").isNull(), F.array(F.lit("no such tool")))
        .when(F.col("_canonical").isNull(), F.array(F.lit("no JSON")))
        .when(~is_object, F.array(F.lit("no object")))
        .otherwise(found)
    )
    return out.withColumn("problems", problems).drop("fields", "_args", "_values", "_kinds")


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with their position in the conversation by level, turn and identifier.

    Rows are numbered within slices of TURNS turns and slices within the conversation, so that a
    conversation of any length never meets in one group.
    """
    piece = F.floor(F.col("turn") / TURNS)
    rows = rows.withColumn("_slice", piece)
    slices = rows.groupBy("conv_id", "level", "_slice").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("level", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        F.col("conv_id").alias("_conv"), F.col("level").alias("_level"), F.col("_slice").alias("_piece"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead")
    )
    same = (F.col("conv_id") == F.col("_conv")) & (F.col("level") == F.col("_level")) & F.col("_slice").eqNullSafe(F.col("_piece"))
    rows = rows.join(slices, same).drop("_conv", "_level", "_piece")
    inside = F.row_number().over(Window.partitionBy("conv_id", "level", "_slice").orderBy("turn", "call_id", "arguments"))
    return rows.withColumn("position", (F.col("_ahead") + inside).cast("int")).drop("_slice", "_ahead")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, name, turn, level, position, n_results, result_turn, problems, valid, canonical_json.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), uses (array of call_ids whose results it
    needs). ``results``: conv_id, turn, call_id, content. Identifiers count within a conversation. A call
    without results has n_results 0; of several the first by turn is linked. Of several calls with one
    identifier the first by turn, name, arguments and uses counts, the others have the problem "duplicate
    identifier"; rows that are equal in all of these are one call, returned as often as given. Used identifiers
    without a call are a problem; so is a call on or behind a cycle, whose level and position are null.
    Position orders the calls of a conversation by level, turn and identifier from 1. Calls with a null
    conv_id or call_id are returned unlinked with the problem "no identifier". Results without a call
    are left out. Empty tables give no rows.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("uses", F.array().cast("array<string>")).alias("uses"))
    key = F.when(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.concat_ws("\u0001", F.col("conv_id").cast("string"), "call_id"))
    calls = common.stored(calls.withColumn("call_key", key), "tc-calls")
    whole = F.struct("turn", "name", "arguments", "uses")
    first = calls.filter("call_key IS NOT NULL").groupBy("call_key").agg(F.min(whole).alias("first_call"))
    answers = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").select(key.alias("call_key"), "turn", "content")
    answers = answers.groupBy("call_key").agg(F.count("*").alias("n_results"), F.min("turn").alias("result_turn"), F.min_by("content", F.struct("turn", "content")).alias("content"))
    uses = calls.filter("call_key IS NOT NULL").select("call_key", F.col("conv_id"), F.explode(F.array_distinct("uses")).alias("used")).filter("used IS NOT NULL")
    uses = uses.select(F.concat_ws("\u0001", F.col("conv_id").cast("string"), "used").alias("before"), F.col("call_key").alias("after"), "used").distinct()
    there = uses.join(first.select(F.col("call_key").alias("before")), "before", "left_semi")
    lost = uses.join(first.select(F.col("call_key").alias("before")), "before", "left_anti")
    lost = lost.groupBy(F.col("after").alias("call_key")).agg(F.sort_array(F.collect_set(F.concat(F.lit("uses unknown "), "used"))).alias("lost"))
    order = levels(there.select("before", "after"), first)
    rows = checked(calls, schemas).join(first, "call_key", "left").join(answers, "call_key", "left").join(lost, "call_key", "left").join(order, "call_key", "left")
    again = F.col("call_key").isNotNull() & ~whole.eqNullSafe(F.col("first_call"))
    problems = F.concat(
        F.col("problems"),
        F.coalesce("lost", F.array().cast("array<string>")),
        F.when(F.col("call_key").isNull(), F.array(F.lit("no identifier"))).otherwise(F.array().cast("array<string>")),
        F.when(again, F.array(F.lit("duplicate identifier"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("call_key").isNotNull() & F.col("level").isNull(), F.array(F.lit("cyclic"))).otherwise(F.array().cast("array<string>")),
    )
    rows = rows.withColumn("problems", problems)
    placed = _positions(common.stored(rows.filter("level IS NOT NULL"), "tc-rows"))
    rows = placed.unionByName(rows.filter("level IS NULL").withColumn("position", F.lit(None).cast("int")))
    return rows.select(
        "conv_id",
        "call_id",
        "name",
        "turn",
        "level",
        "position",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "result_turn",
        F.array_join("problems", "; ").alias("problems"),
        (F.size("problems") == 0).alias("valid"),
        F.concat(
            F.lit('{"arguments":'), F.coalesce("_canonical", F.lit("null")),
            F.lit(',"id":'), F.coalesce(F.to_json(F.col("call_id").cast("variant")), F.lit("null")),
            F.lit(',"name":'), F.coalesce(F.to_json(F.col("name").cast("variant")), F.lit("null")),
            F.lit(',"result":'), F.coalesce(F.to_json(F.col("content").cast("variant")), F.lit("null")), F.lit("}"),
        ).alias("canonical_json"),
    )
