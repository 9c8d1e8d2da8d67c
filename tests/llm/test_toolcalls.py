from tallyroom.llm import toolcalls

SCHEMAS = [("find", "q", "string", True), ("find", "n", "integer", False), ("find", "where", "object", False), ("rate", "x", "number", True), ("rate", "tags", "array", False), ("rate", "on", "boolean", False)]
CALL = "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>, level string"
RESULT = "conv_id long, turn long, call_id string, content string"


def _run(spark, calls, results=()):
    rows = toolcalls.linked(
        spark.createDataFrame([(*c, "x") for c in calls], CALL),
        spark.createDataFrame(list(results), RESULT),
        spark.createDataFrame(SCHEMAS, "name string, field string, kind string, required boolean"),
    ).collect()
    return {(r["conv_id"], r["call_id"], r["turn"]): r for r in rows}


def test_links_orders_and_serialises(spark):
    calls = [
        (1, 5, "c", "rate", '{"x": 1.5}', ["b", "a"]),
        (1, 1, "a", "find", ' {"q" : "é\\n" , "n": 2, "where": {"z": 1, "b": [1, {"y": null, "a": true}]}} ', None),
        (1, 3, "b", "rate", '{"x": 3, "tags": [], "on": false}', ["a", "a"]),
        (2, 1, "a", "find", '{"q":"other conversation"}', []),
    ]
    got = _run(spark, calls, [(1, 4, "b", "late"), (1, 2, "b", 'first "quoted"'), (1, 9, "zz", "orphan")])
    assert [(got[1, k, t]["level"], got[1, k, t]["position"]) for k, t in (("a", 1), ("b", 3), ("c", 5))] == [(0, 1), (1, 2), (2, 3)]
    assert got[2, "a", 1]["position"] == 1 and all(r["valid"] for r in got.values())
    b = got[1, "b", 3]
    assert (b["n_results"], b["result_turn"]) == (2, 2)
    assert b["canonical_json"] == '{"arguments":{"on":false,"tags":[],"x":3},"id":"b","name":"rate","result":"first \\"quoted\\""}'
    assert got[1, "a", 1]["canonical_json"] == '{"arguments":{"n":2,"q":"é\\n","where":{"b":[1,{"a":true,"y":null}],"z":1}},"id":"a","name":"find","result":null}'
    assert got[1, "a", 1]["n_results"] == 0


def test_problems(spark):
    calls = [
        (1, 1, "m", "find", "{}", None),
        (1, 2, "t", "find", '{"q": 5, "zz": 1, "n": "3"}', None),
        (1, 3, "j", "find", "{not json", None),
        (1, 4, "l", "find", "[1]", None),
        (1, 5, "u", "unknown", "{}", None),
        (1, 6, "x", "rate", '{"x": 1}', ["gone"]),
        (1, 7, "p", "rate", '{"x": 1}', ["r"]),
        (1, 8, "r", "rate", '{"x": 1}', ["p"]),
        (1, 9, "s", "rate", '{"x": 1}', ["r"]),
        (1, 10, "m", "rate", '{"x": 1}', None),
        (1, 11, "n", "find", None, None),
        (None, 1, "a", "rate", '{"x": 1}', None),
        (1, 12, None, "rate", '{"x": 1}', ["m"]),
        (1, None, "tn", "rate", '{"x": null}', None),
    ]
    got = {k[1:]: r["problems"] for k, r in _run(spark, calls).items() if k[0] == 1}
    assert got["m", 1] == "missing q" and got["t", 2] == "mistyped n; mistyped q; unknown zz"
    assert got["j", 3] == "no JSON" and got["l", 4] == "no object" and got["u", 5] == "no such tool" and got["n", 11] == "no JSON"
    assert got["x", 6] == "uses unknown gone"
    assert got["p", 7] == got["r", 8] == got["s", 9] == "cyclic"
    assert got["m", 10] == "duplicate identifier" and got[None, 12] == "no identifier" and got["tn", None] == "mistyped x"


def test_one_long_conversation_is_numbered_in_slices(spark):
    calls = [(1, t, f"c{t}", "rate", '{"x": 1}', None) for t in range(1500)]
    got = _run(spark, calls)
    assert [got[1, f"c{t}", t]["position"] for t in range(1500)] == list(range(1, 1501))


def test_repeats_and_no_rows(spark):
    row = (1, 1, "a", "rate", '{"x": 1}', None)
    calls = spark.createDataFrame([(*row, "x")] * 2, CALL)
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, kind string, required boolean")
    out = toolcalls.linked(calls, spark.createDataFrame([], RESULT), schemas)
    assert out.count() == 2
    assert toolcalls.linked(calls.limit(0), spark.createDataFrame([], RESULT), schemas).count() == 0


def test_a_long_chain_is_no_cycle(spark):
    calls = [(1, t, f"c{t}", "rate", '{"x": 1}', [f"c{t - 1}"] if t else None) for t in range(70)]
    calls += [(2, 1, "p", "rate", '{"x": 1}', ["r"]), (2, 2, "r", "rate", '{"x": 1}', ["p"])]
    got = _run(spark, calls)
    assert [(got[1, f"c{t}", t]["level"], got[1, f"c{t}", t]["position"], got[1, f"c{t}", t]["valid"]) for t in range(70)] == [(t, t + 1, True) for t in range(70)]
    assert got[2, "p", 1]["problems"] == got[2, "r", 2]["problems"] == "cyclic"
