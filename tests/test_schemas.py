"""Schema inference and folds, against brute force on small fixtures."""

import json
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from specloom.functions.json_values import as_object, producing_members, with_strict_json
from specloom.operators.parameter_merge import merge_parameters
from specloom.operators.schema_fold import fold_bodies, merge_schemas, oldest_entries, rejected_bodies, render_bodies, stored_keys, winning_schemas
from specloom.operators.schema_infer import infer_schemas
from specloom.plans.build import body_schemas
from specloom.schemas import PARAMETERS

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def obj(**members):
    return {"type": "object", "properties": members}


def arr(items):
    return {"type": "array", "items": items}


STR, NUM, BOOL = {"type": "string"}, {"type": "number"}, {"type": "boolean"}

VALUES = [
    ('{"n":"x","a":30,"c":"y"}', obj(n=STR, a=NUM, c=STR)),
    ('{"jobs":[{"t":"a","c":"b"},{"t":"a","c":"b","s":1}],"adr":{"st":"m","zip":[1,2]}}',
     obj(jobs=arr(obj(t=STR, c=STR, s=NUM)), adr=obj(st=STR, zip=arr(NUM)))),
    ('{"p":null}', obj()),
    ('{"n":"x","a":1,"p":null}', obj(n=STR, a=NUM)),
    ('[{"n":"x","a":1},{"n":"y","a":"z"}]', arr(obj(n=STR, a=STR))),
    ("[1,2,3]", arr(NUM)),
    ('[[1],[2]]', arr({"type": "array"})),
    ('[{"a":1},2,null,{"b":true}]', arr(obj(a=NUM, b=BOOL))),
    ('[{"a":{"x":1}},{"a":{"y":1}},{"a":null},{"a":[]}]', arr(obj(a=obj(y=NUM)))),
    ('{"e":{},"l":[],"ln":[null,1],"m":[true,"x"]}', obj(e=obj(), m=arr(BOOL))),
    ('{"q\\"]\\\\":{"[":"{"}}', obj(**{'q"]\\': obj(**{"[": STR})})),
    ('{"type":"x","properties":{"items":[{"type":1}]}}', obj(type=STR, properties=obj(items=arr(obj(type=NUM))))),
    ("true", BOOL), ("-1.5e3", NUM), ('"s"', STR),
]


def test_infer_schemas(spark):
    df = spark.createDataFrame([(i, "k", v) for i, (v, _) in enumerate(VALUES)], "i int, key string, value string")
    df = with_strict_json(df, "value", "v").withColumn("value", F.to_json("v")).drop("v")
    got = {r.i: json.loads(r.schema) for r in infer_schemas(df).collect()}
    assert [got[i] for i in range(len(VALUES))] == [schema for _, schema in VALUES]


def test_infer_any_depth(spark):
    depth = 40
    text = '{"a":' * depth + "1" + "}" * depth
    df = spark.createDataFrame([("k", text)], "key string, value string")
    row = infer_schemas(df).first()
    node = json.loads(row.schema)
    for _ in range(depth):
        node = node["properties"]["a"]
    assert node == NUM and len(row.fields) == depth + 1


def test_fields_name_types(spark):
    df = spark.createDataFrame([("k", '{"a":[{"b":1}],"c":[true],"d":"x"}')], "key string, value string")
    fields = [(list(f.path), f.type, f.items_type) for f in infer_schemas(df).first().fields]
    assert fields == [
        (["k"], "object", None), (["k", "a"], "array", "object"), (["k", "a", "b"], "number", None),
        (["k", "c"], "array", "boolean"), (["k", "d"], "string", None),
    ]


def test_merge_schemas(spark):
    s, n = '{"type":"string"}', '{"type":"number"}'
    wide, narrow = '{"properties":{"x":{},"y":{}},"type":"object"}', '{"properties":{"x":{}},"type":"object"}'
    left = [("only", s), ("both", s), ("empty_right", s), ("empty_left", "{}"), ("null_left", "null"),
            ("keep_empty", "{}"), ("null_right", s), ("nested", wide)]
    right = [("both", n), ("new", n), ("empty_right", "{}"), ("empty_left", n), ("drop", "{}"),
             ("null_right", "null"), ("nested", narrow)]
    frame = lambda rows: spark.createDataFrame([("a", *r) for r in rows], "api_id string, key string, schema string")
    got = {r.key: r.schema for r in merge_schemas(frame(left), frame(right), ["api_id"]).collect()}
    assert got == {
        "only": s, "both": n, "new": n, "empty_right": s, "empty_left": n, "keep_empty": "{}",
        "null_right": "null", "nested": narrow,
    }


def _samples(spark, rows):
    return spark.createDataFrame(
        [(a, f"{i:04d}", T0 + timedelta(seconds=s), b) for i, (a, s, b) in enumerate(rows)],
        "api_id string, id string, event_at timestamp, body string",
    )


def _side(df):
    return df.withColumn("side", F.lit("request"))


def test_body_kinds(spark):
    bodies = {"{}": "body", "[]": "body", "null": "body", "[[1]]": "body", "3": "rejected", "{} x": "rejected",
              '{"a":1e400}': "rejected", '"s"': "rejected"}
    samples = _samples(spark, [(b, 0, b) for b in bodies] + [("none", 0, "")])
    got = {r.api_id: r.kind for r in fold_bodies(samples, ["api_id"]).collect()}
    assert got == bodies
    bad = {r.line for r in rejected_bodies(samples.withColumn("side", F.lit("x"))).collect()}
    assert bad == {b for b, kind in bodies.items() if kind == "rejected"}


def _random_value(rng, depth):
    kind = rng.choice(["s", "n", "b", "null", "o", "a", "oa"] if depth else ["s", "n", "b", "null"])
    if kind == "o":
        return {rng.choice("abc"): _random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if kind == "a":
        first = _random_value(rng, 0)
        return [first] * rng.randint(0, 2)
    if kind == "oa":
        return [{rng.choice("xyz"): _random_value(rng, depth - 1)} for _ in range(rng.randint(1, 3))]
    return {"s": "t", "n": rng.random(), "b": True, "null": None}[kind]


def _node(value):
    """Brute force: the schema of a value, or None if it says nothing."""
    if value is None or value == [] or (isinstance(value, list) and value[0] is None):
        return None
    if isinstance(value, dict):
        found = {k: _node(v) for k, v in value.items()}
        return obj(**{k: n for k, n in found.items() if n})
    if isinstance(value, list):
        if isinstance(value[0], dict):
            return arr(obj(**{k: n for o in value for k, n in _node(o)["properties"].items()}))
        return arr({"type": _node(value[0])["type"] if not isinstance(value[0], list) else "array"})
    return BOOL if isinstance(value, bool) else NUM if isinstance(value, (int, float)) else STR


def test_fold_is_oldest_wins_over_stored(spark):
    rng = random.Random(7)
    rows, expected, stored = [], {}, []
    for a in range(30):
        seed = obj(a=STR, zz=NUM) if a % 2 else None
        if seed:
            stored.append((f"api{a}", json.dumps(seed), True))
        state = dict(seed["properties"]) if seed else {}
        times = rng.sample(range(100), 8)
        bodies = {t: {rng.choice("abcd"): _random_value(rng, 3) for _ in range(3)} for t in times}
        rows += [(f"api{a}", t, json.dumps(b)) for t, b in bodies.items()]
        for t in sorted(times, reverse=True):
            state.update(_node(bodies[t])["properties"])
        expected[f"api{a}"] = obj(**state)
    due = spark.createDataFrame([(k,) for k in expected], "api_id string")
    old = spark.createDataFrame(stored, "api_id string, body_schema string, has_body boolean")
    rows = body_schemas(_side(due), _side(_samples(spark, rows)), _side(old))[0].collect()
    assert {r.api_id: json.loads(r.body_schema) for r in rows} == expected


def test_empty_schemas(spark):
    due = spark.createDataFrame([("none",), ("blank",), ("array",)], "api_id string")
    old = spark.createDataFrame([], "api_id string, body_schema string, has_body boolean")
    samples = _samples(spark, [("blank", 0, ""), ("array", 0, "[1]")])
    rows = body_schemas(_side(due), _side(samples), _side(old))[0].collect()
    assert {r.api_id: (r.body_schema, r.has_body) for r in rows} == {
        "none": ("{}", False), "blank": ("{}", False), "array": ('{"properties":{},"type":"object"}', True),
    }


def test_stored_schema_survives_rendering(spark):
    text = '{"properties":{"a":{"items":{"properties":{"x":{"type":"number"}},"type":"object"},"type":"array"},"b":{"type":"string"}},"type":"object"}'
    df = spark.createDataFrame([("a", text)], "api_id string, body_schema string")
    assert render_bodies(stored_keys(df, ["api_id"]), ["api_id"]).first().body_schema == text


def test_one_hot_api_reduces_before_the_shuffle(spark):
    samples = spark.range(0, 20000, 1, 8).select(
        F.lit("hot").alias("api_id"), F.format_string("%08d", "id").alias("id"),
        F.timestamp_seconds("id").alias("event_at"),
        F.concat(F.lit('{"v":'), F.when(F.col("id") == 0, F.lit('"first"')).otherwise(F.col("id").cast("string")), F.lit("}")).alias("body"),
    )
    plan = oldest_entries(samples, ["api_id"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort [" not in plan
    folded = fold_bodies(samples, ["api_id"])
    rows = {r.kind: (r.value, r.n) for r in folded.collect()}
    assert rows == {"key": ('""', 20000), "body": (None, 20000)}


def test_no_values_are_shaped_for_the_oldest_times(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    bodies = ['{"k":1,"n":null,"e":[],"l":[null,1],"o":{"a":[]}}', '{"k":"s","":[[1]]}', "[1]", "null", "7", "x", ""]
    samples = spark.createDataFrame([("a", str(i), at + timedelta(seconds=i), b) for i, b in enumerate(bodies)], "api_id string, id string, event_at timestamp, body string")
    found = oldest_entries(samples, ["api_id"])
    assert "[true]" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.kind, r.key, (r.event_at.second), r.n) for r in found.collect()} == {
        ("body", None, 0, 4), ("rejected", None, 4, 2), ("key", "k", 0, 2), ("key", "o", 0, 1), ("key", "", 1, 1),
    }


def test_equal_times_go_by_id(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [("a", "3", at, '{"k":1,"m":1}'), ("a", "1", at, '{"k":"s"}'), ("a", "2", at, '{"k":true,"m":[1]}'), ("a", "0", at, "7")]
    samples = spark.createDataFrame(rows, "api_id string, id string, event_at timestamp, body string")
    got = {(r.kind, r.key): (r.value, r.n) for r in fold_bodies(samples, ["api_id"]).collect()}
    assert got == {("key", "k"): ('""', 3), ("key", "m"): ("[0]", 2), ("body", None): (None, 3), ("rejected", None): (None, 1)}


def test_array_of_very_many_unlike_objects(spark):
    value = json.dumps([{f"k{i}": i, "last": i if i % 2 else "s"} for i in range(50_000)], separators=(",", ":"))
    started = time.time()
    row = infer_schemas(spark.createDataFrame([("a", value)], "key string, value string")).first()
    assert len(row.fields) == 50_002 and time.time() - started < 60
    assert json.loads(row.schema)["items"]["properties"]["last"] == {"type": "number"}


def test_merge_parameters(spark):
    schema = f"api_id string, parameters {PARAMETERS}"
    p = lambda name, kind, required=False: (name, kind, "v", "query", required)
    stored = spark.createDataFrame([("a", [p("x", "string", True), p("y", "any"), p("z", "integer")])], schema)
    samples = spark.createDataFrame(
        [("a", [p("x", "string"), p("y", "string")]), ("a", [p("z", "string"), p("n", "boolean")]),
         ("b", [p("q", "string")]), ("c", []), ("d", None)], schema)
    got = {r.api_id: [(q.name, q.type, q.value, q.required) for q in r.parameters]
           for r in merge_parameters(stored, samples).collect()}
    assert got == {
        "a": [("n", "boolean", "", False), ("x", "string", "", True), ("y", "any", "", False), ("z", "any", "", False)],
        "b": [("q", "string", "", False)],
    }
