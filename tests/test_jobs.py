"""Scans and whole jobs on small archives."""

import gzip
import json
import os
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specloom.operators.documents import api_documents
from specloom.operators.records import accepted, parse_records
from specloom.operators.updates import soft_delete
from specloom.plans.build import build_structures, run_build
from specloom.plans.documents import load_document, load_documents
from specloom.plans.ingest import ingest_archive, ingest_folder
from specloom.schemas import conform, empty_table
from specloom.session import scratch_path
from specloom.sources import archive
from specloom.sources.archive import hour_paths, read_archive, read_folder
from specloom.sources.tables import Warehouse
from specloom.streaming.incremental import log_stream, run_incremental

T0 = datetime(2023, 5, 31, 23, tzinfo=timezone.utc)
NOW = datetime(2023, 8, 1, tzinfo=timezone.utc)


def line(path, at, body, request_body="", method="GET", query=None):
    record = {
        "started_at": int(at.timestamp() * 1000),
        "request": {"url": f"https://h.example.com:443{path}", "method": method, "body": request_body,
                    "querystring": query or {}},
        "response": {"status": 200, "body": body},
    }
    return json.dumps(json.dumps(record, separators=(",", ":")), ensure_ascii=False)[1:-1]


def put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(gzip.compress("".join(x + "\n" for x in lines).encode()))


def folders(spark, start, end):
    df = hour_paths(spark.range(1), F.lit(start), F.lit(end))
    return [r.folder for r in df.collect()]


def test_hour_paths(spark):
    assert folders(spark, T0, T0 + timedelta(hours=1)) == ["logs/proxy/2023-05-31/23/", "logs/proxy/2023-06-01/00/"]
    half = T0 + timedelta(minutes=30)
    assert folders(spark, half, T0 + timedelta(minutes=75)) == ["logs/proxy/2023-05-31/23/"]
    assert folders(spark, T0, T0) == ["logs/proxy/2023-05-31/23/"]
    assert folders(spark, half, T0) == []


def test_archive_scan(spark, tmp_path):
    hour = tmp_path / "logs/proxy/2023-05-31/23"
    put(hour, "a.gz", ["one", "t\rwo"])
    put(hour / "deep", "b.log.gz", ["three"])
    (hour / "a.gz.metadata").write_text("skip")
    (hour / "plain.log").write_text("skip")
    put(tmp_path / "logs/proxy/2023-06-01/05", "late.gz", ["skip"])
    got = read_archive(spark, str(tmp_path), T0, T0 + timedelta(hours=2))
    assert sorted(r.value for r in got.collect()) == ["one", "t\rwo", "three"]
    assert read_archive(spark, str(tmp_path), T0 + timedelta(days=9), T0 + timedelta(days=9)).isEmpty()
    assert read_archive(spark, str(tmp_path), T0, T0 - timedelta(hours=1)).isEmpty()


def test_folder_scan_goes_by_content(spark, tmp_path):
    put(tmp_path, "a.gz", ["one"])
    put(tmp_path, "unnamed", ["two", "three"])
    (tmp_path / "not_gzip").write_text("skip")
    (tmp_path / "fake.gz").write_text("skip")
    whole = gzip.compress(b"".join(b"line %d\n" % i for i in range(5000)))
    (tmp_path / "damaged").write_bytes(whole[: len(whole) // 2])
    put(tmp_path / "sub", "c.gz", ["skip"])
    rows = read_folder(spark, str(tmp_path)).collect()
    values = {r.value for r in rows}
    assert {"one", "two", "three", "line 0"} <= values and "skip" not in values
    assert sorted(r.file.rsplit("/", 1)[1] for r in rows if r.damage) == ["damaged", "fake.gz"]


@pytest.mark.parametrize("name", ["x.gz", "x"])
def test_damaged_files_give_their_lines_and_a_reason(spark, tmp_path, name):
    lines = [b"line %d %s" % (i, os.urandom(20).hex().encode()) for i in range(20000)]
    whole = gzip.compress(b"\n".join(lines) + b"\n")
    (tmp_path / name).write_bytes(whole[: len(whole) // 2])
    rows = read_folder(spark, str(tmp_path)).collect()
    found = [r.value.encode() for r in rows if r.value is not None]
    assert len(found) > 5000 and found[:-1] == lines[: len(found) - 1]
    assert [r.position for r in rows if r.value is not None] == list(range(len(found)))
    assert [r.damage for r in rows if r.damage] == ["file is damaged: it ends early"]


@pytest.mark.parametrize("content", [b"\x1f\x8b", b"\x1f\x8b\n", b"\x1f\x8b\n\nx\n\n", b"\n", b"\n\nx"])
def test_files_cut_at_newlines_are_put_together(content):
    rows = content.removesuffix(b"\n").split(b"\n")
    names = ["path", "size", "content"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, (["a%20b"], [len(content)], [row])))) for row in rows]
    assert [(path, b"".join(parts)) for path, parts in archive._raw_files(batches)] == [("a b", content)]
    short = [pa.RecordBatch.from_pydict(dict(zip(names, (["x"], [9], [b"\x1f\x8b"]))))]
    with pytest.raises(OSError):
        [list(parts) for _, parts in archive._raw_files(short)]


def test_files_that_fit_in_no_row(spark, tmp_path, monkeypatch):
    """Files over the limits of a row give what smaller ones give: lines, positions, damage; in folder and stream."""
    lines = [b"line %d %s" % (i, os.urandom(20).hex().encode()) for i in range(20000)]
    whole = gzip.compress(b"\n".join(lines) + b"\n")
    files = {"whole": whole, "cut": whole[: len(whole) // 2], "a b%[1]": whole + gzip.compress(b"more\n")}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
        (tmp_path / f"{name}.gz").write_bytes(content)
    (tmp_path / "foreign").write_bytes(b"\0" * 300_000)

    def found(df):
        out = {}
        df = df.selectExpr("file", "md5(value) AS value", "position", "damage").orderBy("file", F.col("position").asc_nulls_last())
        for r in df.collect():
            out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.value, r.position, r.damage))
        return out

    expected = found(read_folder(spark, str(tmp_path)))
    assert sorted(expected) == sorted([*files, *(f"{n}.gz" for n in files)])
    assert all(expected[n] == expected[f"{n}.gz"] for n in files)
    assert len(expected["whole"]) == 20000 and len(expected["a b%[1]"]) == 20001
    assert expected["cut"][-1] == (None, None, "file is damaged: it ends early") and len(expected["cut"]) > 5000
    monkeypatch.setattr(archive, "WHOLE_FILE_BYTES", 100_000)
    limits = {"spark.sql.sources.binaryFile.maxLength": "100000", "spark.sql.files.maxPartitionBytes": "50000"}
    old = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        assert found(read_folder(spark, str(tmp_path))) == expected
        seen = []
        log_stream(spark, str(tmp_path)).writeStream.option("checkpointLocation", scratch_path(spark, "stream")).trigger(
            availableNow=True
        ).foreachBatch(lambda df, _: seen.append(found(df))).start().awaitTermination()
        assert seen == [{name: rows for name, rows in expected.items() if name.endswith(".gz")}]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_files_of_several_members_and_odd_endings(spark, tmp_path):
    a, b = gzip.compress(b"one\ntw"), gzip.compress(b"o\n\nlast")
    (tmp_path / "members.gz").write_bytes(a + b)
    (tmp_path / "padded.gz").write_bytes(a + b"\0" * 512)
    (tmp_path / "tail.gz").write_bytes(a + b"garbage after the end")
    (tmp_path / "empty.gz").write_bytes(b"")
    flipped = bytearray(gzip.compress(b"checked\n" * 100))
    flipped[-6] ^= 1
    (tmp_path / "sum.gz").write_bytes(bytes(flipped))
    found = {}
    for r in read_folder(spark, str(tmp_path)).orderBy("file", F.col("position").asc_nulls_last()).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(r.value if r.damage is None else "damage")
    assert found["members.gz"] == ["one", "two", "", "last"] and found["padded.gz"] == ["one", "tw"]
    assert found["tail.gz"] == ["one", "tw", "damage"] and "empty.gz" not in found
    assert found["sum.gz"] == ["checked"] * 100 + ["damage"]


def test_long_lines_and_equal_lines_on_both_routes(spark, tmp_path):
    long = line("/big", T0, json.dumps({"k": "v" * 6_000_000}))
    hour = tmp_path / "archive/logs/proxy/2023-05-31/23"
    same = line("/same", T0, "{}")
    put(hour, "a.gz", [long, same, same])
    put(tmp_path / "folder", "a", [long, same, same])
    for number, ingest in enumerate((
        lambda w: ingest_archive(spark, str(tmp_path / "archive"), T0, T0, w, NOW, batch=1),
        lambda w: ingest_folder(spark, str(tmp_path / "folder"), w, NOW, batch=1),
    )):
        warehouse = Warehouse(spark, scratch_path(spark, f"route{number}"))
        ingest(warehouse)
        assert sorted(r.path for r in warehouse.read_snapshot("apis").collect()) == ["/big", "/same"]
        ids = [r.id for r in warehouse.read_appended("sample_requests").collect()]
        assert len(ids) == len(set(ids)) == 3
        assert warehouse.read_appended("quarantine").isEmpty()


def test_unread_batches_are_built_whatever_their_stamps(spark, tmp_path):
    """A batch stamped before a build but written after it is not lost, and nothing is read twice."""
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    put(tmp_path / "1", "a", [line("/a", T0, '{"x":1}')])
    put(tmp_path / "2", "a", [line("/a", T0 - timedelta(1), '{"x":"s","late":true}')])
    ingest_folder(spark, str(tmp_path / "1"), warehouse, NOW, batch=1)
    run_build(warehouse, NOW + timedelta(seconds=100), version=3)
    ingest_folder(spark, str(tmp_path / "2"), warehouse, NOW + timedelta(seconds=50), batch=2)
    run_build(warehouse, NOW + timedelta(seconds=200), version=5)
    assert schema_of(documents(warehouse), "/a")["properties"] == {"late": {"type": "boolean"}, "x": {"type": "string"}}
    assert [r.batch for r in warehouse.read_snapshot("consumed").orderBy("batch").collect()] == [1, 2]


def test_same_stamp_for_ingest_and_build(spark, tmp_path):
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    for batch, body in enumerate(('{"x":1}', '{"x":"s"}'), start=1):
        put(tmp_path / str(batch), "a", [line("/a", T0 + timedelta(batch), body)])
        ingest_folder(spark, str(tmp_path / str(batch)), warehouse, NOW + timedelta(batch), batch)
        run_build(warehouse, NOW + timedelta(batch), version=2 * batch + 1)
    assert schema_of(documents(warehouse), "/a")["properties"] == {"x": {"type": "string"}}


def test_rebuild_after_soft_delete(spark, tmp_path):
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    put(tmp_path / "1", "a", [line("/a", T0, '{"x":1}', query={"p": "1"})])
    ingest_folder(spark, str(tmp_path / "1"), warehouse, NOW, batch=1)
    run_build(warehouse, NOW, version=3)
    later = NOW + timedelta(1)
    for table in ("request_structures", "response_structures"):
        warehouse.write_snapshot(table, soft_delete(warehouse.read_snapshot(table), F.lit(True), later), 4)
    put(tmp_path / "2", "a", [line("/a", T0, '{"y":1}', query={"q": "1"})])
    ingest_folder(spark, str(tmp_path / "2"), warehouse, later, batch=2)
    run_build(warehouse, later, version=5)
    for table in ("request_structures", "response_structures"):
        rows = warehouse.read_snapshot(table).collect()
        assert sorted(r.deleted_at is None for r in rows) == [False, True] and len({r.id for r in rows}) == 2
    got = documents(warehouse)
    assert schema_of(got, "/a")["properties"] == {"y": {"type": "number"}}
    assert [p["name"] for p in got["/a"]["paths"]["/a"]["get"]["parameters"]] == ["q"]


def test_days_and_batches_are_pruned(spark, tmp_path):
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    for batch in (1, 2):
        put(tmp_path / str(batch), "a", [line("/a", T0, "{}")])
        ingest_folder(spark, str(tmp_path / str(batch)), warehouse, NOW + timedelta(batch), batch)
    day = warehouse.read_appended("sample_requests", since=(NOW + timedelta(2)).date())
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert day.count() == 1 and warehouse.read_appended("sample_requests").count() == 2
    assert warehouse.read_appended("sample_requests", [2]).inputFiles()[0].split("batch=")[1].startswith("2/")


def test_oldest_precedence_and_deep_merge(spark, tmp_path):
    arrivals = ['{"x":1,"o":{"a":1,"l":[{"p":1}]}}', '{"x":"s","o":{"b":2,"l":[{"q":1}]},"y":1}']
    found = {}
    for precedence in ("newest", "oldest"):
        for merge in ("shallow", "deep"):
            warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
            for batch, body in enumerate(arrivals, start=1):
                folder = tmp_path / precedence / merge / str(batch)
                put(folder, "a", [line("/a", T0 + timedelta(batch), body)])
                ingest_folder(spark, str(folder), warehouse, NOW + timedelta(batch), batch)
                run_build(warehouse, NOW + timedelta(batch), 2 * batch + 1, precedence=precedence, merge=merge)
            found[precedence, merge] = schema_of(documents(warehouse), "/a")["properties"]
    number, text = {"type": "number"}, {"type": "string"}
    items = lambda p: {"items": {"properties": p, "type": "object"}, "type": "array"}
    assert found["newest", "shallow"]["x"] == text and found["oldest", "shallow"]["x"] == number
    assert found["newest", "shallow"]["o"]["properties"] == {"b": number, "l": items({"q": number})}
    assert found["oldest", "shallow"]["o"]["properties"] == {"a": number, "l": items({"p": number})}
    for precedence in ("newest", "oldest"):
        deep = found[precedence, "deep"]
        assert deep["o"]["properties"] == {"a": number, "b": number, "l": items({"p": number, "q": number})}
        assert deep["y"] == number


def test_filter_on_unstaged_records_stays_above_the_parsing(spark):
    lines = spark.createDataFrame([("f", line("/a/1", T0, "{}")), ("f", "x")], "file string, value string")
    good = accepted(parse_records(lines, NOW))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter isnull(reason") < plan.index("Generate inline")
    assert [r.path for r in good.collect()] == ["/a/{id}"]


def test_build_reads_only_samples_since_the_oldest_cursor(spark):
    apis = conform(
        spark.createDataFrame([("a", T0), ("b", NOW)], "id string, latest_build_structure timestamp"), "apis")
    sample = "api_id string, id string, created_at timestamp, event_at timestamp, body string"
    rows = [("a", "1", T0 - timedelta(1), T0, '{"old":1}'), ("a", "2", T0, T0, '{"x":1}'), ("b", "3", T0, T0, '{"y":1}')]
    samples = spark.createDataFrame(rows, sample)
    built = build_structures(
        apis, conform(samples, "sample_requests"), conform(samples, "sample_responses"),
        empty_table(spark, "request_structures"), empty_table(spark, "response_structures"), NOW)
    schemas = {r.api_id: r.body_schema for r in built.response_structures.collect()}
    assert schemas == {"a": '{"properties":{"x":{"type":"number"}},"type":"object"}'}


def documents(warehouse):
    return {r.path: json.loads(r.document) for r in load_documents(warehouse).collect()}


def schema_of(document, path, method="get"):
    return document[path]["paths"][path][method]["responses"]["200"]["content"]["application/json"]["schema"]


def test_jobs_end_to_end(spark, tmp_path):
    hour = tmp_path / "logs/proxy/2023-05-31/23"
    put(hour, "a.gz", [
        line("/v1/private/list/31?limit=20", T0, '{"a":1,"b":{"x":1}}', query={"limit": "20"}),
        line("/v1/private/list/7", T0 - timedelta(1), '{"a":"s","b":null}', query={"q": "1"}),
        line("/v1/private/list/8", T0, "{} tail"),
        line("/v2/add", T0, None, '{"k":[1]}', "POST"),
        '{"broken"',
    ])
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    ingest_archive(spark, str(tmp_path), T0, T0, warehouse, NOW, batch=1, partitions=3)
    run_build(warehouse, NOW + timedelta(seconds=1), version=3)
    got = documents(warehouse)
    path = "/v1/private/list/{id}"
    assert set(got) == {path, "/v2/add"}
    assert schema_of(got, path) == {
        "type": "object",
        "properties": {"a": {"type": "string"}, "b": {"type": "object", "properties": {"x": {"type": "number"}}}},
    }
    op = got[path]["paths"][path]["get"]
    assert [(p["name"], p["schema"]["type"]) for p in op["parameters"]] == [("limit", "integer"), ("q", "string")]
    assert op["security"] == [{"Bearer": []}] and got[path]["servers"] == [{"url": "h.example.com"}]
    add = got["/v2/add"]["paths"]["/v2/add"]["post"]
    assert set(add) == {"parameters", "requestBody"} and add["parameters"] == []
    bad = {(r.stage, r.reason) for r in warehouse.read_appended("quarantine").collect()}
    assert bad == {("clean", "bad escape"), ("response body", "body is not a JSON object, array or null")}

    api = warehouse.read_snapshot("apis").where(F.col("path") == path).first()
    assert load_document(warehouse, api.id).first().path == path
    assert load_document(warehouse, "0" * 24).isEmpty()
    with pytest.raises(ValueError):
        load_document(warehouse, "nope")


def test_ingest_folder_and_missing_sections(spark, tmp_path):
    put(tmp_path, "x", [line("/a", T0, None)])
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    ingest_folder(spark, str(tmp_path), warehouse, NOW, batch=1)
    docs = api_documents(
        warehouse.read_snapshot("apis"),
        empty_table(spark, "request_structures"),
        empty_table(spark, "response_structures"),
        title="T",
    )
    document = json.loads(docs.first().document)
    assert document["paths"] == {"/a": {"get": {}}} and document["info"]["title"] == "T"


def test_incremental_runs(spark, tmp_path):
    """A later run's value beats the stored one; inside a run the oldest wins; nothing new, no change."""
    root = tmp_path / "in"
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    checkpoint = scratch_path(spark, "stream")
    run = lambda: run_incremental(spark, str(root), warehouse, checkpoint, NOW)
    put(root, "1.gz", [line("/a", T0, '{"x":1,"y":1}', query={"p": "1"}), line("/b", T0, "{}")])
    run()
    put(root, "2.gz", [
        line("/a", T0 + timedelta(2), '{"x":true,"z":[]}', query={"r": "1"}),
        line("/a", T0 + timedelta(1), '{"x":"s","z":[1]}'),
    ])
    run()
    got = documents(warehouse)
    expected = {"x": {"type": "string"}, "y": {"type": "number"},
                "z": {"type": "array", "items": {"type": "number"}}}
    assert schema_of(got, "/a")["properties"] == expected
    names = [p["name"] for p in got["/a"]["paths"]["/a"]["get"]["parameters"]]
    assert names == ["p", "r"] and schema_of(got, "/b") == {"type": "object", "properties": {}}
    run()
    assert documents(warehouse) == got
    assert warehouse.read_appended("sample_requests").count() == 4


def test_old_files_are_taken_up(spark, tmp_path):
    root = tmp_path / "in"
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    checkpoint = scratch_path(spark, "stream")
    put(root, "1.gz", [line("/a", T0, "{}")])
    run_incremental(spark, str(root), warehouse, checkpoint, NOW)
    put(root, "2.gz", [line("/old", T0, "{}")])
    os.utime(root / "2.gz", (1_000_000_000, 1_000_000_000))
    run_incremental(spark, str(root), warehouse, checkpoint, NOW)
    assert set(documents(warehouse)) == {"/a", "/old"}


def test_a_large_file_among_small_ones_is_spread_by_its_size(spark, tmp_path, monkeypatch):
    hour = tmp_path / "logs/proxy/2023-05-31/23"
    for i in range(100):
        put(hour, f"{i}.gz", [line("/a", T0, "{}")])
    body = json.dumps({f"k{i}": "x" * 50 for i in range(20)})
    put(hour, "large.gz", [line(f"/a/{i}", T0 + timedelta(microseconds=i), body) for i in range(2000)])
    folders = archive.archive_folders(spark, str(tmp_path), T0, T0)
    assert archive.parsing_tasks(spark, folders) is None and archive.parsing_tasks(spark, []) is None
    monkeypatch.setattr(archive, "LARGE_FILE_BYTES", 1 << 12)
    assert archive.parsing_tasks(spark, folders) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(archive, "TASK_BYTES", 1 << 10)
    assert archive.parsing_tasks(spark, folders) > spark.sparkContext.defaultParallelism
    warehouse = Warehouse(spark, scratch_path(spark, "jobs"))
    records = ingest_archive(spark, str(tmp_path), T0, T0, warehouse, NOW, batch=1)
    large = records.where(F.col("file").contains("large.gz"))
    assert large.select(F.input_file_name()).distinct().count() > 1 and (large.count(), records.count()) == (2000, 2100)
