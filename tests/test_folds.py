"""State of folds by event time, and rollups that gates read instead of samples."""

from datetime import timedelta
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from specloom.operators.gate import due_apis, due_by_newest, newest_in_rollups
from specloom.operators.schema_fold import fold_bodies, merge_folds
from specloom.operators.updates import soft_delete
from specloom.plans.build import read_rollups, run_build
from specloom.plans.documents import load_documents, refresh_documents
from specloom.plans.ingest import ingest_lines
from specloom.schemas import empty_table
from specloom.session import scratch_path
from specloom.sources.tables import Warehouse
from test_jobs import NOW, T0, documents, line, schema_of

DAY = timedelta(1)
LOG = [
    line("/a", T0 + 2 * DAY, '{"x":1,"o":{"p":1},"late":null}', method="PUT", query={"q": "1"}),
    line("/a", T0, '{"x":"s","tags":[{"k":1}]}', method="GET"),
    line("/a", T0 + DAY, '{"o":[1],"late":true,"tags":[]}', method="POST", query={"q": "z"}),
    line("/b/1", T0 + DAY, "[]", '{"r":1}'), line("/b/2", T0, "7", '{"r":"s"}'), line("/b/3", T0 + 3 * DAY, '{"only":{"d":{"e":1}}}'),
]


def build(spark, batches, precedence="event"):
    warehouse = Warehouse(spark, scratch_path(spark, "folds"))
    for batch, values in enumerate(batches, start=1):
        lines = spark.createDataFrame([("f", v) for v in values], "file string, value string")
        ingest_lines(lines, warehouse, NOW + batch * DAY, batch)
        if precedence:
            run_build(warehouse, NOW + batch * DAY, 2 * batch + 1, precedence=precedence)
    return warehouse


def shown(warehouse):
    return sorted(map(tuple, load_documents(warehouse).collect()))


def test_any_order_of_arrival_ends_in_the_same_documents(spark):
    whole = shown(build(spark, [LOG]))
    parts = LOG[:1] + LOG[3:4], LOG[1:3] + LOG[4:]
    for order in permutations(parts):
        assert shown(build(spark, order)) == whole
    assert [(path, method) for _, path, method, _ in whole] != [] and {m for _, p, m, _ in whole if p == "/a"} == {"GET"}


def test_state_is_the_least_of_time_and_id(spark):
    samples = spark.createDataFrame(
        [("a", "2", 5, '{"k":1}'), ("a", "1", 5, '{"k":"s","n":[1]}'), ("a", "0", 6, '{"k":true,"n":1,"z":{}}')],
        "api_id string, id string, at int, body string",
    ).withColumn("event_at", F.timestamp_seconds("at"))
    by, state = ["api_id"], empty_table(spark, "folds").drop("side")
    for part in (F.col("id") == "0", F.col("id") == "2", F.col("id") == "1", F.lit(True)):
        state = merge_folds(state, fold_bodies(samples.where(part), by), by)
    assert {r.key: (r.id, r.schema) for r in state.collect()} == {
        "k": ("1", '{"type":"string"}'), "n": ("1", '{"items":{"type":"number"},"type":"array"}'), "z": ("0", '{"properties":{},"type":"object"}'),
    }


def test_deleted_structures_and_other_precedences_forget_the_state(spark):
    warehouse = build(spark, [[line("/a", T0, '{"x":1}')]])
    for table in ("request_structures", "response_structures"):
        warehouse.write_snapshot(table, soft_delete(warehouse.read_snapshot(table), F.lit(True), NOW), 4)

    def add(batch, body, at, precedence):
        lines = spark.createDataFrame([("f", line("/a", at, body))], "file string, value string")
        ingest_lines(lines, warehouse, NOW + batch * DAY, batch)
        run_build(warehouse, NOW + batch * DAY, 2 * batch + 1, precedence=precedence)
        return {k: v["type"] for k, v in schema_of(documents(warehouse), "/a")["properties"].items()}

    # The successor knows nothing of its predecessor's keys.
    assert add(2, '{"x":"s"}', T0 + DAY, "event") == {"x": "string"}
    assert add(3, '{"x":true}', T0 + 2 * DAY, "event") == {"x": "string"}
    # A build by arrival replaces the key, and later ones by event time take it as older than all.
    assert add(4, '{"x":true}', T0 + 3 * DAY, "newest") == {"x": "boolean"}
    assert add(5, '{"x":1,"y":1}', T0 - DAY, "event") == {"x": "boolean", "y": "number"}
    with pytest.raises(ValueError):
        run_build(warehouse, NOW, 99, precedence="event", merge="deep")


def test_gates_read_rollups_and_no_samples(spark):
    warehouse = build(spark, [LOG[:3], LOG[3:]], precedence=None)
    apis = warehouse.read_snapshot("apis")
    for side, table in (("request", "sample_requests"), ("response", "sample_responses")):
        for gate in ("fixed", "legacy", "unread"):
            due = due_by_newest(apis, newest_in_rollups(read_rollups(warehouse), side), gate)
            assert any("sample_rollups" in f for f in due.inputFiles()) and not any("sample_re" in f for f in due.inputFiles())
            assert sorted(due.collect()) == sorted(due_apis(apis, warehouse.read_appended(table), gate).collect())
    assert read_rollups(warehouse, [2]).where("side = 'request'").first().n == 3


def test_batches_without_a_rollup_are_rolled_up_from_their_samples(spark):
    warehouse = build(spark, [LOG[:3], LOG[3:]], precedence=None)
    older = Warehouse(spark, scratch_path(spark, "older"))
    for table in ("sample_requests", "sample_responses"):
        for batch in (1, 2):
            older.append(table, warehouse.read_appended(table, [batch]), batch, (NOW + batch * DAY).date())
    older.append("sample_rollups", warehouse.read_appended("sample_rollups", [2]), 2, (NOW + 2 * DAY).date())
    assert sorted(read_rollups(older).collect()) == sorted(read_rollups(warehouse).collect())


def test_only_documents_whose_inputs_changed_are_rendered(spark):
    warehouse = build(spark, [LOG[:3] + LOG[3:5]])
    first = {r.path: r for r in refresh_documents(warehouse, 3).collect()}
    assert {r.version for r in first.values()} == {3} and len(first) == 2
    # The same inputs: nothing is rendered. Another title: everything is.
    assert {r.version for r in refresh_documents(warehouse, 4).collect()} == {3}
    assert {r.version for r in refresh_documents(warehouse, 5, title="T").collect()} == {5}
    lines = spark.createDataFrame([("f", line("/c", T0, "{}")), ("f", line("/b/9", T0, "[]", '{"more":1}'))], "file string, value string")
    ingest_lines(lines, warehouse, NOW + 9 * DAY, 9)
    run_build(warehouse, NOW + 9 * DAY, 19, precedence="event")
    gone = warehouse.read_snapshot("apis").withColumn("deleted_at", F.when(F.col("path") == "/a", F.lit(NOW)))
    refresh_documents(warehouse, 19)
    found = {r.path: r.version for r in refresh_documents(warehouse, 20, title="T").collect()}
    assert found == {"/a": 20, "/b/{id}": 20, "/c": 20}
    warehouse.write_snapshot("apis", gone, 21)
    left = refresh_documents(warehouse, 21, title="T")
    assert {r.path: r.version for r in left.collect()} == {"/b/{id}": 20, "/c": 20}
    columns = ["api_id", "path", "method", "document"]
    assert sorted(left.select(*columns).collect()) == sorted(load_documents(warehouse, title="T").select(*columns).collect())
