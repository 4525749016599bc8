"""Queries on the derived log over larger tables."""

import gzip
import json
import threading

import pytest
from pyspark.sql import functions as F

from checks import queries
from checks.derived_log import _text, log_lines
from checks.queries import STAMP, registered
from specloom.sources.tables import Warehouse
from specloom.streaming import incremental

#: 2024-01-01T00:00:00.123456Z, what lines of remainder 3 say.
MICROS = 1704067200123456


def events(spark, ids):
    return ids.select(
        F.col("id").alias("event_id"),
        F.timestamp_millis(F.lit(1704100000000) + F.col("id")).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 50).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "purchase").otherwise("view").alias("event_type"),
        (F.col("id") / 4).alias("value"),
        F.lit('{"k": 1}').alias("props"),
    ).coalesce(1)


@pytest.mark.parametrize("n", [5412, 5413, 12000])
def test_sums_of_clean_lines_beyond_a_long(spark, tmp_path, n):
    events(spark, spark.range(3, 100 * n, 100)).write.parquet(f"{tmp_path}/events.parquet")
    found = registered()["clean_lines"](spark, str(tmp_path))
    row = found.first()
    assert (row.reason, row.n, row.n_extractable, int(row.receive_micros)) == ("", n, n, n * MICROS)
    assert dict(found.dtypes)["text_digests"] == "bigint"
    assert (dict(found.dtypes)["receive_micros"] == "bigint") == (n * MICROS < 2**63)


def test_clean_lines_of_no_events(spark, tmp_path):
    events(spark, spark.range(0)).write.parquet(f"{tmp_path}/events.parquet")
    found = registered()["clean_lines"](spark, str(tmp_path))
    assert found.collect() == []
    assert dict(found.dtypes)["receive_micros"] == dict(found.dtypes)["text_digests"] == "bigint"


def test_lines_of_one_row_group_are_dealt_out(spark):
    table = events(spark, spark.range(20_000).union(spark.range(5))).withColumn("ts", F.col("ts").cast("timestamp"))
    lines = log_lines(table)
    assert lines.rdd.getNumPartitions() == 5
    shares = lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 5 and max(r["count"] for r in shares) < 6000
    assert [r.event_id for r in lines.select("event_id").sort("event_id").collect()] == sorted([*range(20_000), *range(5)])


def test_json_texts_without_a_pattern(spark):
    values = [None, "", "[", "]", '"[x]"', "a\\b\n]", "é😀"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", _text(F.col("v")).alias("t"))
    assert [r.t for r in rows.collect()] == ["null", *[json.dumps(v, ensure_ascii=False) for v in values[1:]]]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_stream_moves_lines_of_few_files(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gz").write_bytes(gzip.compress("".join(f"line {i}\n" for i in range(5000)).encode()))
    found = []

    def ingest(lines, *rest):
        found.append((lines.rdd.getNumPartitions(), sorted((r.value, r.position) for r in lines.collect())))

    monkeypatch.setattr(incremental, "ingest_lines", ingest)
    monkeypatch.setattr(incremental, "run_build", lambda *a, **k: None)
    warehouse = Warehouse(spark, f"{tmp_path}/warehouse")
    incremental.run_incremental(spark, str(tmp_path / "in"), warehouse, str(tmp_path / "stream"), STAMP)
    assert found == [(spark.sparkContext.defaultParallelism, sorted((f"line {i}", i) for i in range(5000)))]


def test_orders_of_arrival_are_one_beside_another(spark, tmp_path, monkeypatch):
    events(spark, spark.range(300)).write.parquet(f"{tmp_path}/events.parquet")
    together, ingest = threading.Barrier(3, timeout=60), queries.ingest_lines

    def meeting(lines, warehouse, now, batch):
        if batch == 1:
            together.wait()
        return ingest(lines, warehouse, now, batch)

    monkeypatch.setattr(queries, "ingest_lines", meeting)
    rows = registered()["arrival_orders"](spark, str(tmp_path)).collect()
    documents = [sorted(r[:-1] for r in rows if r.arrival_order == order) for order in range(3)]
    assert documents[0] and documents[0] == documents[1] == documents[2]
