"""Log lines to request/response records; every refused line keeps its reason."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from specloom.functions.json_values import as_object, is_absent, is_string, with_strict_json
from specloom.functions.parameters import parameter_rows
from specloom.functions.text import with_clean_text
from specloom.functions.urls import api_id, path_template, with_url_parts
from specloom.session import settled

# Epoch milliseconds of the years 1 to 9999.
_MIN_MILLIS, _MAX_MILLIS = -62135596800000, 253402300799999


def _field(parent: str, name: str) -> Column:
    return F.try_variant_get(parent, f"$.{name}", "variant")


def _text_or_absent(value: Column) -> Column:
    return is_absent(value) | is_string(value)


def _as_text(name: str) -> Column:
    return F.try_variant_get(name, "$", "string")


def record_reason() -> Column:
    """Why a parsed line is no record, or null.

    Reads ``_rec``, its parts ``_request`` and ``_response``, and the fields taken from
    those. The container checks come first, in this order. A value with a known field is an
    object, so the costly test for one is left to the odd lines.
    """
    rec, request, response = F.col("_rec"), F.col("_request"), F.col("_response")
    url, query, query_map = F.col("_url"), F.col("_query"), F.col("_query_map")

    def is_text(value):
        return F.coalesce(is_string(value), F.lit(False))

    no_status_or_body = F.col("_status").isNull() & F.col("_response_body").isNull()
    return (
        F.when(
            rec.isNull() | (request.isNull() & ~F.is_variant_null(rec) & as_object(rec).isNull()),
            F.lit("invalid json"),
        )
        .when(request.isNull(), F.lit("missing request info"))
        .when(url.isNull() & as_object(request).isNull(), F.lit("request info is not a map"))
        .when(response.isNull(), F.lit("missing response info"))
        .when(no_status_or_body & as_object(response).isNull(), F.lit("response info is not a map"))
        .when(~is_text(url), F.lit("url is not a string"))
        .when(~is_text(F.col("_method")), F.lit("method is not a string"))
        .when(~_text_or_absent(F.col("_body")), F.lit("request body is not a string"))
        .when(~is_absent(query) & query_map.isNull(), F.lit("querystring is not a map"))
        .when(
            F.exists(F.map_values(query_map), lambda v: ~is_string(v)),
            F.lit("querystring value is not a string"),
        )
        .when(~_text_or_absent(F.col("_response_body")), F.lit("response body is not a string"))
    )


def status_code(value: Column) -> Column:
    """Anything castable to an integer, else 0. Strings must be plain decimals."""
    text = F.try_variant_get(value, "$", "string")
    decimal = F.regexp_extract(text, r"^([+-]?[0-9]+)(?:\.0+)?\z", 1)
    return F.coalesce(
        F.when(is_string(value), decimal.try_cast("bigint")).otherwise(
            F.try_variant_get(value, "$", "bigint")
        ),
        F.lit(0).cast("bigint"),
    )


def parse_records(
    lines: DataFrame,
    received_at: datetime,
    key: Column | None = None,
    max_line_bytes: int | None = None,
) -> DataFrame:
    """One output row per input line (columns ``file``, ``value``), refused ones included.

    Accepted rows have a null ``reason``; refused rows keep their ``line``. ``key``
    identifies a line for its id; by default file, ``position`` in it (if there is such a
    column) and content do, so equal lines differ and a retried task assigns the same ids.
    A row with ``damage`` stands for a file and is refused for that reason.
    ``received_at`` stands in for a missing event time.

    Stage the result if it is used more than once.
    """
    if key is None:
        key = F.concat_ws("\n", *[c for c in ("file", "position", "value") if c in lines.columns])
    damage = F.col("damage") if "damage" in lines.columns else F.lit(None).cast("string")
    df = with_clean_text(lines.withColumns({"_key": key, "_damage": damage}), "value", max_line_bytes)
    df = with_strict_json(df, "text", "_rec")
    df = df.withColumns(
        {"_request": _field("_rec", "request"), "_response": _field("_rec", "response")}
    )
    df = df.withColumns(
        {
            "_url": _field("_request", "url"),
            "_method": _field("_request", "method"),
            "_body": _field("_request", "body"),
            "_query": _field("_request", "querystring"),
            "_query_map": as_object(_field("_request", "querystring")),
            "_status": _field("_response", "status"),
            "_response_body": _field("_response", "body"),
        }
    )
    df = df.withColumn("_reason", F.when(F.col("clean_reason").isNull(), record_reason()))
    good = F.coalesce("clean_reason", "_reason").isNull()
    millis = F.try_variant_get("_rec", "$.started_at", "bigint")
    query = F.transform_values("_query_map", lambda _, v: v.try_cast("string"))
    df = df.select(
        "file",
        F.when(~good, F.col("value")).alias("line"),
        F.when(F.col("_damage").isNotNull(), F.lit("file"))
        .when(F.col("clean_reason").isNotNull(), F.lit("clean"))
        .when(F.col("_reason").isNotNull(), F.lit("record"))
        .alias("stage"),
        F.coalesce("_damage", "clean_reason", "_reason").alias("reason"),
        F.substring(F.sha2("_key", 256), 1, 24).alias("id"),
        F.when(good, _as_text("_url")).alias("_url"),
        F.when(good, _as_text("_method")).alias("method"),
        F.when(good, parameter_rows(query)).alias("parameters"),
        F.when(good, F.coalesce(_as_text("_body"), F.lit(""))).alias("body"),
        F.when(good, status_code(F.col("_status"))).alias("http_status_code"),
        F.when(good, _as_text("_response_body")).alias("response_body"),
        F.coalesce(
            F.when(millis.between(_MIN_MILLIS, _MAX_MILLIS), F.timestamp_millis(millis)),
            F.lit(received_at),
        ).alias("event_at"),
        "receive_time",
    )
    df = with_url_parts(df, F.col("_url")).drop("_url")
    df = df.withColumn("path", path_template(F.col("path"))).withColumn(
        "api_id", api_id(F.col("path"))
    )
    return settled(df)


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.col("reason").isNull())


def quarantined(records: DataFrame) -> DataFrame:
    return records.where(F.col("reason").isNotNull()).select("file", "line", "stage", "reason")
