"""Tables in buckets, changes that rewrite touched buckets only, and pages by seeking."""

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from specloom.operators import changes, updates
from specloom.operators.rows import after, find_page, page_after
from specloom.session import scratch_path
from specloom.sources.buckets import BucketTable

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
COLUMNS = "id string, created_at timestamp, updated_at timestamp, deleted_at timestamp, name string, age int"


def rows(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("id"), F.timestamp_seconds(F.col("id") % 50).alias("created_at"),
        F.timestamp_seconds(F.lit(0)).alias("updated_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
        F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), (F.col("id") % 90).cast("int").alias("age"),
    )


def table(spark, df, buckets=64):
    made = BucketTable(spark, scratch_path(spark, "buckets"), df.schema, buckets)
    made.write(df, 1)
    return made


def folders(made, version):
    path = f"{made.path}/data/v={version}".removeprefix("file:")
    return sorted(f for f in os.listdir(path) if f.startswith("bucket=")) if os.path.isdir(path) else []


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_changed_row_rewrites_one_folder(spark):
    df = rows(spark, 5000)
    made = table(spark, df)
    assert len(folders(made, 1)) == 64 and values(made.read()) == values(df)
    done = changes.update_by_id(made, 2, "r77", {"name": "new"}, NOW)
    assert done == changes.Change(1, 0, 0, (made.bucket_of("r77"),)) and folders(made, 2) == [f"bucket={made.bucket_of('r77')}"]
    done = changes.delete_one(made, 3, F.col("name") == "n3")
    assert (done.deleted, len(folders(made, 3))) == (1, 1)
    done = changes.upsert_by_id(made, 4, spark.createDataFrame([("r78", "x"), ("fresh", "y")], "id string, name string"), NOW)
    assert (done.modified, done.inserted, len(folders(made, 4))) == (1, 1, len(done.buckets))
    same = updates.delete_one(updates.update_by_id(df, "r77", {"name": "new"}, NOW), F.col("name") == "n3")
    same = updates.upsert_by_id(same, spark.createDataFrame([("r78", "x"), ("fresh", "y")], "id string, name string"), NOW)
    assert values(made.read()) == values(same)
    # Earlier versions are still there.
    assert values(made.read(below=2)) == values(df)


def test_changes_without_a_hit_write_nothing(spark):
    made = table(spark, rows(spark, 100))
    nothing = F.col("name") == "absent"
    for done in (
        changes.update_one(made, 2, nothing, {"age": 1}, NOW), changes.update_many(made, 2, nothing, {"age": 1}, NOW),
        changes.delete_one(made, 2, nothing), changes.delete_by_id(made, 2, "absent"), changes.soft_delete(made, 2, nothing, NOW),
        changes.upsert_by_id(made, 2, made.read().limit(0).select("id", "age"), NOW),
    ):
        assert done == changes.Change()
    assert made.versions() == [1]


def test_many_rows_and_keys_as_on_a_whole_table(spark):
    df = rows(spark, 2000)
    made = table(spark, df, buckets=8)
    assert changes.update_many(made, 2, F.col("age") > 80, {"age": F.col("age") + 1}, NOW).modified == df.where("age > 80").count()
    same = updates.update_many(df, F.col("age") > 80, {"age": F.col("age") + 1}, NOW)
    assert changes.soft_delete(made, 3, F.col("name") == "n1", NOW).modified == df.where("name = 'n1'").count()
    same = updates.soft_delete(same, F.col("name") == "n1", NOW)
    items = spark.createDataFrame([("n1", 5, 1), ("n1", 6, 2), ("other", None, 1)], "name string, age int, turn int")
    new_id = F.concat(F.lit("new-"), "name")
    done = changes.upsert(made, 4, items, ["name"], NOW, new_id, order="turn")
    assert (done.modified, done.inserted) == (1, 1) and len(done.buckets) <= 2
    assert values(made.read()) == values(updates.upsert(same, items, ["name"], NOW, new_id, order="turn"))


def test_a_bucket_may_lose_all_rows_and_a_table_too(spark):
    made = table(spark, rows(spark, 3), buckets=4)
    for version, row in enumerate(("r0", "r1", "r2"), start=2):
        assert changes.delete_by_id(made, version, row).deleted == 1
    assert made.read().collect() == [] and made.manifest() == {} and made.versions() == [1, 2, 3, 4]
    assert changes.upsert_by_id(made, 5, spark.createDataFrame([("back", 1)], "id string, age int"), NOW).inserted == 1
    assert [r.id for r in made.read().collect()] == ["back"]


def test_unfinished_versions_and_odd_tables(spark):
    df = rows(spark, 50).unionByName(rows(spark, 1).withColumn("id", F.lit(None).cast("string")))
    made = table(spark, df, buckets=4)
    # Data without a manifest is what a job that died has left.
    df.limit(1).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{made.path}/data/v=2")
    assert values(made.read()) == values(df) and changes.update_many(made, 2, F.col("id").isNull(), {"age": 99}, NOW).modified == 1
    assert made.read().where("id IS NULL").first().age == 99 and made.read().count() == 51
    with pytest.raises(ValueError):
        BucketTable(spark, made.path, df.schema, 5).read()
    with pytest.raises(ValueError):
        BucketTable(spark, made.path, df.withColumn("bucket", F.lit(1)).schema)
    assert table(spark, df.limit(0)).read().collect() == []


def test_one_id_reads_few_rows(spark):
    made = table(spark, rows(spark, 1_000_000))
    found = made.by_id("r424242")
    assert found.count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert 0 < read < 10_000


@pytest.mark.parametrize("order", [[("a", False)], [("a", True), ("b", False)], [("b", True), ("a", True)], []])
def test_pages_by_seeking_give_every_row_once(spark, order):
    rng = random.Random(9)
    data = [(f"{i:03}", rng.choice([None, 1, 2]), rng.choice([None, "x", "y", ""]), None) for i in range(120)]
    df = spark.createDataFrame(data, "id string, a int, b string, deleted_at timestamp")
    wanted = [r.id for r in df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order], "id").collect()]
    got, last = [], None
    while page := page_after(df, F.lit(True), order, 17, last).collect():
        got += [r.id for r in page]
        last = page[-1].asDict()
    assert got == wanted


def test_far_pages_hold_no_unbounded_rows(spark):
    df = rows(spark, 3000)
    order = [F.col("age").desc()]
    near = find_page(df, F.lit(True), order, limit=30, offset=2500)
    far = find_page(df, F.lit(True), order, limit=30, offset=2500, far_rows=100)
    assert [r.id for r in far.collect()] == [r.id for r in near.collect()]
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (near, far)]
    assert "TakeOrderedAndProject" in plans[0] and "TakeOrderedAndProject" not in plans[1]
    next_ = page_after(df, F.lit(True), [("age", True)], 30, far.collect()[-1].asDict())
    assert "TakeOrderedAndProject(limit=30" in next_._jdf.queryExecution().executedPlan().toString()
    assert str(after([("age", True)], {"age": 3}))


def test_seeking_reaches_the_scan(spark, tmp_path):
    rows(spark, 100).write.parquet(str(tmp_path / "t"))
    page = page_after(spark.read.parquet(str(tmp_path / "t")), F.lit(True), [("age", False)], 5, {"age": 50, "id": "r50"})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,50)" in plan.split("PushedFilters")[1]
