"""Row operators on small tables."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from specloom.operators import rows, updates
from specloom.operators.gate import advance_cursor, due_apis
from specloom.plans.build import move_cursor
from specloom.schemas import conform, empty_table
from specloom.session import scratch_path
from specloom.sources.tables import Warehouse


def day(n):
    return datetime(2024, 1, n, tzinfo=timezone.utc)


NOW = day(31)
SCHEMA = "id string, created_at timestamp, updated_at timestamp, deleted_at timestamp, name string, age int"


@pytest.fixture
def users(spark):
    data = [
        ("a", day(3), day(3), None, "x", 1),
        ("b", day(1), day(1), day(9), "x", 2),
        ("c", day(2), day(2), None, "x", 3),
        ("d", day(2), day(2), None, "y", None),
    ]
    return spark.createDataFrame(data, SCHEMA)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_find_and_first_match(users):
    x = rows.matches({"name": "x"})
    assert set(by_id(rows.find(users, x))) == {"a", "c"}
    assert rows.first_match(users, x).first().id == "c"
    assert rows.first_match(users, rows.matches({"name": "none"})).isEmpty()
    assert rows.by_id(users, "b").isEmpty()
    assert rows.find(users, rows.matches({"age": None})).first().id == "d"
    assert [r.id for r in rows.find_page(users, F.lit(True), limit=2, offset=1).collect()] == ["c", "d"]
    assert [r.id for r in rows.find_page(users, F.lit(True), [F.col("created_at").desc()], offset=1).collect()] == ["c", "d"]
    assert rows.count_rows(users, x).first().n == 3


def test_page_without_limit_passes_no_single_task(spark):
    many = spark.range(0, 5000, 1, 7).select(
        F.format_string("%08d", "id").alias("id"), (F.col("id") % 11).alias("n"), F.lit(None).cast("timestamp").alias("deleted_at"))
    page = rows.find_page(many, F.col("n") != 3, [F.col("n").desc()], offset=1234)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan
    expected = sorted(((i % 11, f"{i:08d}") for i in range(5000) if i % 11 != 3), key=lambda r: (-r[0], r[1]))[1234:]
    assert [(r.n, r.id) for r in page.collect()] == expected


def test_item_fields():
    item = {"id": "i", "created_at": 1, "name": "", "age": 0, "tags": None}
    assert rows.item_fields(item) == {"name": "", "age": 0, "tags": None}
    assert rows.item_fields(item, ["age", "name"], ignore_empty=True) == {"tags": None}
    assert rows.item_fields(item, ["age"]) == {"name": "", "age": 0, "tags": None}


def test_update_touches_the_first_match_even_if_deleted(users):
    got = by_id(updates.update_one(users, F.col("name") == "x", {"age": None, "id": "z", "created_at": NOW}, NOW))
    assert got["b"].age is None and got["b"].updated_at.day == 31 and got["b"].created_at.day == 1
    assert (got["a"].age, got["c"].age) == (1, 3)
    none = by_id(updates.update_one(users, F.col("name") == "none", {"age": 9}, NOW))
    assert none == by_id(users)


def test_update_many_and_soft_delete(users):
    got = by_id(updates.update_many(users, F.col("age") > 1, {"name": F.concat("name", F.lit("!"))}, NOW))
    assert [got[i].name for i in "abcd"] == ["x", "x!", "x!", "y"]
    gone = updates.soft_delete(users, F.col("name") == "x", NOW)
    assert set(by_id(rows.find(gone, F.lit(True)))) == {"d"}
    assert set(by_id(rows.find(updates.soft_delete_by_id(users, "a", NOW), F.lit(True)))) == {"c", "d"}


def test_delete(users):
    assert set(by_id(updates.delete_one(users, F.col("name") == "x"))) == {"a", "c", "d"}
    assert set(by_id(updates.delete_by_id(users, "zz"))) == {"a", "b", "c", "d"}


def test_upsert(spark, users):
    items = spark.createDataFrame([("x", 10, 1), ("x", None, 2), ("new", 5, 1)], "name string, age int, n int")
    got = updates.upsert(users, items, ["name"], NOW, F.lit("fresh"), order="n")
    got = by_id(got)
    assert got["b"].age is None and got["b"].updated_at.day == 31
    assert (got["a"].age, got["c"].age) == (1, 3)
    assert got["fresh"].age == 5 and got["fresh"].created_at.day == 31
    counts = updates.upsert_counts(users, items, ["name"], "n").first()
    assert (counts.matched, counts.inserted) == (1, 1)


def test_upsert_by_id(spark, users):
    items = spark.createDataFrame([("a", "n", None), ("q", "n", 7)], "id string, name string, age int")
    got = by_id(updates.upsert_by_id(users, items, NOW))
    assert (got["a"].name, got["a"].age, got["a"].created_at.day) == ("n", None, 3)
    assert (got["q"].age, got["q"].created_at.day) == (7, 31) and len(got) == 5


def test_gates(spark):
    apis = spark.createDataFrame([("new", None), ("old", day(5)), ("idle", day(20)), ("none", None)],
                                 "id string, latest_build_structure timestamp")
    apis = conform(apis, "apis")
    samples = conform(
        spark.createDataFrame([(a, day(10)) for a in ("new", "old", "idle")], "api_id string, created_at timestamp"),
        "sample_requests")
    assert {r.api_id for r in due_apis(apis, samples).collect()} == {"new", "old"}
    assert {r.api_id for r in due_apis(apis, samples, "legacy").collect()} == {"new", "idle"}
    moved = by_id(advance_cursor(apis, due_apis(apis, samples), NOW))
    assert moved["old"].latest_build_structure.day == 31 and moved["none"].latest_build_structure is None
    with pytest.raises(LookupError):
        move_cursor(apis, spark.createDataFrame([("absent",)], "api_id string"), NOW)
    there = move_cursor(apis, spark.createDataFrame([("old",)], "api_id string"), NOW)
    with pytest.raises(LookupError):
        move_cursor(there, spark.createDataFrame([("old",)], "api_id string"), NOW)
    with pytest.raises(ValueError):
        due_apis(apis, samples, "other")


def test_warehouse_batches_and_snapshots(spark):
    warehouse = Warehouse(spark, scratch_path(spark, "test"))
    assert warehouse.read_snapshot("types").isEmpty() and warehouse.read_appended("types").isEmpty()
    one = conform(spark.createDataFrame([("1", "n")], "id string, name string"), "types")
    warehouse.insert("types", one, 1, NOW)
    warehouse.insert("types", one, 1, NOW)
    warehouse.insert("types", one, 2, NOW)
    assert warehouse.read_appended("types").count() == 2
    assert warehouse.read_appended("types", [2]).count() == 1
    assert warehouse.batches("types") == [1, 2]
    with pytest.raises(ValueError):
        warehouse.insert("types", one, 2, day(30))
    warehouse.write_snapshot("apis", empty_table(spark, "apis"), 3)
    warehouse.write_snapshot("apis", conform(one, "apis"), 10)
    assert warehouse.versions("apis") == [3, 10]
    assert warehouse.read_snapshot("apis").count() == 1
    assert warehouse.read_snapshot("apis", below=10).isEmpty()
