"""An access log derived from the ``events`` table, one line per event.

Everything follows from the event by arithmetic on its id, so SQL over ``events`` can state
what a correct engine must find without reading the log. ``event_id % 100`` selects how a
line is distorted; ``event_id % 23`` selects unusual response bodies.
"""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specloom.operators.records import parse_records
from specloom.session import stage

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)
ORIGIN = "https://gw.example.com:443"

# Lines that one task makes: so few where cores would be idle, else so many.
_FEW_LINES, _MANY_LINES = 5_000, 100_000

_DEEP = '{"deep":{"a":{"b":{"c":{"d":{"e":{"f":{"g":[{"h":true}]}}}}}}}}'


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table; zone-less timestamps are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _mod(n: int) -> Column:
    return F.col("event_id") % n


def _choose(key: Column, cases: dict, default: Column) -> Column:
    out = None
    for k, v in cases.items():
        value = F.lit(v) if isinstance(v, str) else v
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out.otherwise(default)


def _with_url(events: DataFrame) -> DataFrame:
    digest = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws(
        "-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    is_write = F.col("event_type").isin("purchase", "signup")
    path = F.concat(
        F.lit("/v1/"),
        F.when(is_write, F.lit("private/")).otherwise(F.lit("")),
        F.col("event_type"),
        F.lit("/"),
        F.when(_mod(10) == 4, uuid).otherwise(F.col("user_id").cast("string")),
        F.when(_mod(3) == 0, F.lit(":confirm")).otherwise(F.lit("")),
    )
    url = F.concat(F.lit(ORIGIN), path, F.lit("?limit=20&page="), _mod(7).cast("string"))
    return events.withColumns({"url": url, "is_write": is_write})


def _query_string() -> Column:
    return F.concat(
        F.lit('{"limit":"20","page":"'), _mod(7).cast("string"), F.lit('"'),
        F.when(_mod(4) == 0, F.lit(',"q":"x y"')).otherwise(F.lit("")),
        F.when(_mod(9) == 0, F.lit(',"1":"on"')).otherwise(F.lit("")),
        F.when(_mod(9) == 3, F.lit(',"12":"z"')).otherwise(F.lit("")),
        F.lit("}"),
    )


def _response_body() -> Column:
    value = F.col("value").cast("string")
    usual = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"),
        F.lit(',"value":'), F.when(_mod(5) == 0, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value),
        F.when(F.col("event_type") == "error", F.lit(',"error":"broken \\"pipe\\""')).otherwise(F.lit("")),
        F.when(_mod(2) == 0, F.lit(',"user":{"id":1,"tier":"gold"}')).otherwise(
            F.lit(',"user":{"id":1,"flag":true}')
        ),
        F.lit(',"tags":'),
        _choose(
            _mod(6),
            {0: "[]", 1: '["a"]', 2: "[1]", 3: '[{"x":1},{"y":"s"}]', 4: "[null]"},
            F.lit("[[1]]"),
        ),
        F.lit(',"note":null}\n'),
    )
    unusual = _choose(
        _mod(23),
        {
            5: '{"id":1} x', 6: "[1,2]", 7: "null", 8: "3", 9: '{"id":1e400}',
            10: '{"id":1,"id":"s"}', 12: _DEEP,
        },
        usual,
    )
    return F.when(_mod(11) == 0, F.lit(None)).when(_mod(13) == 0, F.lit("")).otherwise(unusual)


def _text(value: Column) -> Column:
    """A JSON string literal, or null."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, 2, F.length(listed) - 2)


def dealt_out(events: DataFrame) -> DataFrame:
    """The same rows in parts of like size, evenly mixed, however few row groups and files the table has.

    A row group is one task's, and a million events make as many lines of half a kilobyte, which that task would also
    write and often parse. Only the count passes the driver; it comes from the files' footers.
    """
    count, cores = events.count(), events.sparkSession.sparkContext.defaultParallelism
    return events.repartition(min(count // _FEW_LINES + 1, max(4 * cores, count // _MANY_LINES + 1)))


def log_lines(events: DataFrame) -> DataFrame:
    """(event_id, ts, key, file, value): the archived line of every event."""
    h = _mod(100)
    df = _with_url(dealt_out(events))
    df = df.withColumn("_response_body", _text(_response_body()))
    method = F.when(F.col("is_write"), F.lit('"POST"')).otherwise(F.lit('"GET"'))
    body = _text(F.when(F.col("is_write"), F.col("props")).otherwise(F.lit("")))
    request = F.concat(
        F.when(h == 24, F.lit("{")).otherwise(F.concat(F.lit('{"method":'), method, F.lit(","))),
        F.lit('"url":'), F.when(h == 23, F.lit("5")).otherwise(_text(F.col("url"))),
        F.lit(',"body":'), F.when(h == 25, F.lit("5")).otherwise(body),
        F.lit(',"querystring":'), _choose(h, {26: "[1]", 27: '{"limit":20}'}, _query_string()),
        F.lit(',"headers":{"accept":"*/*"}}'),
    )
    usual_status = F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200"))
    response = F.concat(
        F.lit('{"status":'), _choose(h, {30: "null", 31: '"201"', 32: "202.7", 33: '"x"'}, usual_status),
        F.lit(',"body":'), F.when(h == 28, F.lit("5")).otherwise(F.col("_response_body")),
        F.lit(',"size":10}'),
    )
    df = df.withColumns({"_request": request, "_response": response})
    request, response = F.col("_request"), F.col("_response")
    record = F.concat(
        F.lit('{"client":"10.0.0.1","started_at":'), F.unix_millis("ts").cast("string"),
        _choose(h, {18: "", 19: ',"request":null', 20: ',"request":"r"'}, F.concat(F.lit(',"request":'), request)),
        _choose(h, {21: "", 22: ',"response":null'}, F.concat(F.lit(',"response":'), response)),
        F.lit("}"),
    )
    record = _choose(h, {17: "{not json}", 29: "[1]"}, record)
    df = df.withColumn("_record", record)
    record = F.col("_record")
    df = df.withColumn(
        "_escaped", F.replace(F.replace(record, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    )
    escaped = F.col("_escaped")
    line = _choose(
        h,
        {
            3: F.concat(F.lit("2024-01-01T00:00:00.123456789Z stdout F "), escaped),
            4: F.concat(F.lit("2024-01-01T00:00:00.5Z stderr F  "), escaped),
            7: F.concat(escaped, F.lit(" Content-Type: image/png")),
            8: F.concat(escaped, F.lit(" init.lua:1")),
            9: F.concat(escaped, F.lit(" GET /config?check_hash=1")),
            11: F.concat(escaped, F.lit('"')),
            12: F.concat(escaped, F.lit("\\ud83d\\ude00")),
            13: F.concat(escaped, F.lit("\\/")),
            14: F.replace(escaped, F.lit("/v1/"), F.lit("\\x2fv1\\u002f")),
            15: F.replace(escaped, F.lit("10.0.0.1"), F.lit("\\xC4\\x90\\101\\U0001F600")),
            16: F.concat(escaped, F.lit(" tail")),
        },
        escaped,
    )
    return df.select(
        "event_id", "ts", F.col("event_id").cast("string").alias("key"), F.lit("events").alias("file"),
        line.alias("value"),
    )


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the log, as the ingest job has them: parsed once into a staged table."""
    lines = log_lines(load(spark, sf_dir, "events"))
    return stage(parse_records(lines, NOW, key=F.col("key")), "records")


def write_archive(lines: DataFrame, root: str, service: str = "proxy") -> None:
    """Write lines as ``logs/<service>/YYYY-MM-DD/HH/*.gz`` below ``root``."""
    spark = lines.sparkSession
    staging = f"{root}/staging"
    (
        lines.select(
            "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH").alias("hour")
        )
        .repartition("day", "hour")
        .write.option("compression", "gzip")
        .partitionBy("day", "hour")
        .text(staging)
    )
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = hadoop.Path(staging)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    moves = []
    for day in fs.listStatus(base):
        if not day.isDirectory():
            continue
        target = f"{root}/logs/{service}/{day.getPath().getName().removeprefix('day=')}"
        fs.mkdirs(hadoop.Path(target))
        for hour in fs.listStatus(day.getPath()):
            name = hour.getPath().getName().removeprefix("hour=")
            moves.append((hour.getPath(), hadoop.Path(f"{target}/{name}")))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda move: fs.rename(*move), moves))
