"""Registered queries: one per operator group, each over the whole of its tables."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
import gzip
import zlib
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.derived_log import NOW, load, log_lines, log_records, write_archive
from specloom.functions.text import with_clean_text
from specloom.functions.urls import path_template, with_url_parts
from specloom.operators import catalog, changes, gate, rows, schema_fold, updates
from specloom.operators.documents import api_documents
from specloom.operators.parameter_merge import merge_parameters
from specloom.operators.records import accepted, parse_records, quarantined
from specloom.plans.build import build_structures, read_rollups, run_build
from specloom.plans.documents import load_documents, refresh_documents
from specloom.plans.ingest import append_samples, ingest_archive, ingest_lines
from specloom.schemas import conform, empty_table
from specloom.session import configure, scratch_path, stage
from specloom.sources.archive import hour_paths, read_archive, read_folder, unpacked
from specloom.sources.buckets import BucketTable
from specloom.sources.tables import Warehouse
from specloom.streaming.incremental import run_incremental

STAMP = datetime(2024, 6, 1, tzinfo=timezone.utc)
MID_JANUARY = datetime(2024, 1, 15, tzinfo=timezone.utc)
MARCH = datetime(2024, 3, 1, tzinfo=timezone.utc)


def _micros(name: str) -> Column:
    return F.unix_micros(name).alias(name)


def _ref_path() -> Column:
    return F.regexp_extract("file", r"logs/proxy/[0-9-]+/[0-9]+/", 0)


# Scans

def _span(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """The first and the last full hour of the log."""
    span = load(spark, sf_dir, "events").agg(
        F.date_trunc("hour", F.min("ts")).cast("long").alias("a"), F.date_trunc("hour", F.max("ts")).cast("long").alias("b")
    ).first()
    return datetime.fromtimestamp(span.a, timezone.utc), datetime.fromtimestamp(span.b, timezone.utc)


def hour_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = load(spark, sf_dir, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return hour_paths(span, F.col("a"), F.col("b"))


def gz_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "archive")
    write_archive(log_lines(load(spark, sf_dir, "events")), root)
    records = parse_records(read_archive(spark, root, *_span(spark, sf_dir)), NOW)
    return records.groupBy(_ref_path().alias("folder")).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("reason").isNull()).alias("n_accepted"),
        F.countDistinct("file").alias("n_files"),
    )


def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat folder of gzip files, half of them under other names, in which every line stands twice."""
    lines = log_lines(load(spark, sf_dir, "events")).select("value")
    folder = scratch_path(spark, "folder")
    lines.unionByName(lines).write.option("compression", "gzip").text(folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, status in enumerate(fs.listStatus(hadoop.Path(folder))):
        path = status.getPath()
        if i % 2 and path.getName().endswith(".gz"):
            fs.rename(path, hadoop.Path(f"{folder}/log-{i}"))
    records = parse_records(read_folder(spark, folder), NOW)
    return records.groupBy(
        F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason")
    ).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))


def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a user group's blocks: whole, without their last bytes, with a wrong checksum, or with a tail of other bytes.

    The number of blocks follows from that of lines, so files stay of like size as the table grows.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        user, block = group["user"].iloc[0], group["block"].iloc[0]
        kind = int(user) % 4
        whole = gzip.compress("".join(f"{line}\n" for line in group["value"]).encode(), mtime=0)
        crc = zlib.crc32(whole).to_bytes(4, "little")
        content = [whole, whole[:-4], whole[:-8] + crc + whole[-4:], whole + b"other bytes"][kind]
        return pd.DataFrame({"path": [f"user-{user}-{block}"], "content": [content]})

    events = load(spark, sf_dir, "events")
    blocks = events.count() // 5000 + 1
    lines = log_lines(events).join(events.select("event_id", "user_id"), "event_id")
    keys = (F.col("user_id") % 50).alias("user"), F.pmod("event_id", F.lit(blocks)).alias("block")
    files = lines.select(*keys, "value").groupBy("user", "block").applyInPandas(pack, "path string, content binary")
    records = parse_records(unpacked(files), NOW)
    return records.groupBy("file").agg(
        F.count_if(F.coalesce("stage", F.lit("")) != "file").alias("n_lines"),
        F.count_if(F.col("reason").isNull()).alias("n_accepted"),
        F.count_if(F.col("stage") == "file").alias("n_damaged"),
    )


# Lines, records, URLs, parameters

def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = with_clean_text(log_lines(load(spark, sf_dir, "events")))
    counts = cleaned.groupBy(F.coalesce("clean_reason", F.lit("")).alias("reason")).agg(
        F.count("*").alias("n"),
        F.count_if("extractable").alias("n_extractable"),
        _exact_sum(F.unix_micros("receive_time")).alias("receive_micros"),
        _exact_sum(_digest(F.col("text"))).alias("text_digests"),
    )
    return _long_where_it_fits(stage(counts, "counts"), "receive_micros", "text_digests")


def _exact_sum(number: Column) -> Column:
    """The sum of longs, 0 if there are none, as a decimal: some 5,400 stamps in microseconds are beyond a long."""
    return F.coalesce(F.sum(number.cast("decimal(19,0)")), F.lit(0).cast("decimal(29,0)"))


def _long_where_it_fits(sums: DataFrame, *names: str) -> DataFrame:
    """Columns of exact sums as longs; one that holds a sum beyond a long stays a decimal. A flag for each passes the driver."""
    fits = sums.agg(*[F.max(F.abs(n)).cast("decimal(38,0)").alias(n) for n in names]).first()
    return sums.withColumns({n: F.col(n).cast("long") for n in names if (fits[n] or 0) < 2**63})


def _digest(text: Column) -> Column:
    """A number that stands for a text in sums."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def record_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    return records.groupBy(
        F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("reason", F.lit("")).alias("reason")
    ).agg(F.count("*").alias("n"), F.count("line").alias("n_lines"))


def quarantine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined(log_records(spark, sf_dir)).select(
        "file", "stage", "reason", F.md5(F.col("line")).alias("line_md5")
    ).groupBy("file", "stage", "reason").agg(F.countDistinct("line_md5").alias("n"))


def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_url_parts(load(spark, sf_dir, "pages"), F.col("url")).select("page_id", "host", "path")


def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_url_parts(load(spark, sf_dir, "pages"), F.col("url"))
    logged = accepted(log_records(spark, sf_dir))
    return pages.select(
        F.lit("page").alias("source"),
        F.col("page_id").cast("string").alias("id"),
        path_template(F.col("path")).alias("template"),
    ).unionByName(logged.select(F.lit("log").alias("source"), "id", F.col("path").alias("template")))


def parameter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = accepted(log_records(spark, sf_dir))
    return logged.select("id", F.inline("parameters"))


# Catalog and samples

def api_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.discover_apis(log_records(spark, sf_dir))
    known = catalog.new_apis(
        found.where(F.col("path").contains("view")), empty_table(spark, "apis"), NOW
    )
    added = catalog.new_apis(found, known, STAMP)
    return known.unionByName(added).select(
        "id", "host", "path", "method", _micros("created_at")
    )


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = catalog.request_samples(log_records(spark, sf_dir), NOW)
    return samples.select(
        "id", "api_id", "body", F.size("parameters").alias("n_parameters"),
        _micros("created_at"), _micros("event_at"),
    )


def response_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = catalog.response_samples(log_records(spark, sf_dir), NOW)
    return samples.select(
        "id", "api_id", "http_status_code", F.md5("body").alias("body_md5"), _micros("event_at")
    )


# Parameter and schema folds

def _paths(records: DataFrame) -> DataFrame:
    return accepted(records).select("api_id", "path").distinct()


def param_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    paths = _paths(records)
    stored = paths.select(
        "api_id",
        F.expr(
            "array(named_struct('name', 'page', 'type', if(path LIKE '%private%', 'string', 'integer'),"
            " 'value', '', 'in', 'query', 'required', true),"
            " named_struct('name', 'old', 'type', 'any', 'value', '', 'in', 'query', 'required', false))"
        ).alias("parameters"),
    )
    merged = merge_parameters(stored, catalog.request_samples(records, NOW))
    return merged.join(paths, "api_id").select("path", F.inline("parameters"))


def schema_fields(samples: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = log_records(spark, sf_dir)
        folded = schema_fold.fold_bodies(samples(records, NOW), ["api_id"])
        winners = schema_fold.winning_schemas(folded, ["api_id"])
        nodes = winners.select("api_id", F.inline("fields")).select(
            "api_id",
            F.array_join("path", ".").alias("field"),
            "type",
            F.coalesce("items_type", F.lit("")).alias("items_type"),
        )
        return nodes.join(_paths(records), "api_id").drop("api_id")

    return query


def body_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    folded = schema_fold.fold_bodies(catalog.response_samples(records, NOW), ["api_id"])
    counts = folded.where(F.col("kind") != "key").select("api_id", "kind", "n")
    return counts.join(_paths(records), "api_id").drop("api_id")


def rejected_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = catalog.response_samples(log_records(spark, sf_dir), NOW)
    bad = schema_fold.rejected_bodies(samples.withColumn("side", F.lit("response")))
    return bad.groupBy("line", "stage").agg(F.count("*").alias("n"))


def schema_merge_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    texts = F.array(
        *[F.lit(t) for t in ("{}", "null", '{"type":"string"}', '{"type":"number"}', '{"type":"boolean"}')]
    )

    def side(parity: int) -> DataFrame:
        pick = (F.min("c_custkey") % 5 + 1).cast("int")
        return (
            customer.where(F.col("c_custkey") % 2 == parity)
            .groupBy("c_nationkey", F.col("c_mktsegment").alias("key"))
            .agg(F.element_at(texts, pick).alias("schema"))
        )

    return schema_fold.merge_schemas(side(0), side(1), ["c_nationkey"])


def schema_merge_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a member per market segment: numbers on the left, strings on the right."""
    customer = load(spark, sf_dir, "customer")

    def side(parity: int, kind: str) -> DataFrame:
        member = F.concat(F.lit('"'), "c_mktsegment", F.lit(f'":{{"type":"{kind}"}}'))
        return (
            customer.where(F.col("c_custkey") % 2 == parity)
            .groupBy("c_nationkey", F.lit("k").alias("key"))
            .agg(F.array_join(F.sort_array(F.collect_set(member)), ",").alias("members"))
            .select("c_nationkey", "key", schema_fold.object_schema(F.col("members")).alias("schema"))
        )

    return schema_fold.merge_deep(side(0, "number"), side(1, "string"), ["c_nationkey"])


# Tables

def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a collection; every seventh row is soft-deleted."""
    orders = load(spark, sf_dir, "orders")
    deleted = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    return orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 24, "0").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        deleted.alias("deleted_at"),
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    created = F.lit(MID_JANUARY) + F.make_dt_interval((F.col("c_custkey") % 10).cast("int"))
    return customer.select(
        F.lpad(F.col("c_custkey").cast("string"), 24, "0").alias("id"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        "c_nationkey", "c_mktsegment", "c_name", "c_acctbal",
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = load(spark, sf_dir, "supplier")
    created = F.lit(MID_JANUARY) + F.make_dt_interval((F.col("s_suppkey") % 10).cast("int"))
    return supplier.select(
        F.lpad(F.col("s_suppkey").cast("string"), 24, "0").alias("id"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        "s_nationkey", "s_name", "s_acctbal",
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.unix_micros(c) for c, kind in df.dtypes if kind == "timestamp"}
    )


def find_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": 0, "id": "x"}
    fields = rows.item_fields(wanted, omit_empty=["o_custkey"], ignore_empty=True)
    return _shown(rows.find(_orders(spark, sf_dir), rows.matches(fields)))


def page_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = rows.matches({"o_orderstatus": "O"})
    return _shown(
        rows.find_page(_orders(spark, sf_dir), cond, [F.col("o_totalprice").desc()], limit=50, offset=25)
    )


def api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.discover_apis(log_records(spark, sf_dir))
    apis = catalog.new_apis(found, empty_table(spark, "apis"), NOW).withColumn(
        "created_at", F.col("created_at") + F.make_dt_interval(F.length("path"))
    )
    return rows.api_page(apis, limit=7, offset=3).select("id", "path", "method", _micros("created_at"))


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = rows.matches({"o_orderpriority": "5-LOW", "o_orderstatus": "P"})
    return _shown(rows.first_match(_orders(spark, sf_dir), cond))


def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.discover_apis(log_records(spark, sf_dir))
    apis = catalog.new_apis(found, empty_table(spark, "apis"), NOW)
    orders = _orders(spark, sf_dir)
    return rows.count_rows(apis).select(F.lit("apis").alias("what"), "n").unionByName(
        rows.count_rows(orders, rows.matches({"o_orderstatus": "O"})).select(
            F.lit("open orders").alias("what"), "n"
        )
    )


def valid_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    inputs = load(spark, sf_dir, "pages").select(
        "page_id",
        F.when(n % 5 == 0, F.lit("")).otherwise(F.col("url")).alias("endpoint"),
        F.when(n % 4 == 0, F.lit("request")).when(n % 4 == 1, F.lit("response"))
        .when(n % 4 == 2, F.lit("Request")).alias("type"),
    )
    return rows.valid_inputs(inputs)


def far_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond what a top-k may hold: places of sorted partitions find it."""
    cond, order = rows.matches({"o_orderstatus": "O"}), [F.col("o_totalprice").desc()]
    return _shown(rows.find_page(_orders(spark, sf_dir), cond, order, limit=40, offset=300, far_rows=100))


def page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that follow each other by the last row's values, to the end; the sort columns have very many ties."""
    orders, cond = stage(_orders(spark, sf_dir), "orders"), rows.matches({"o_orderstatus": "O"})
    order = [("o_orderpriority", True), ("deleted_at", False), ("o_custkey", False)]
    size = rows.count_rows(rows.find(orders, cond)).first().n // 5 + 1
    pages, last = [], None
    while True:
        page = stage(rows.page_after(orders, cond, order, size, last), "page")
        end = page.orderBy("o_orderpriority", F.col("o_custkey").desc(), F.col("id").desc()).limit(1).collect()
        if not end:
            break
        pages.append(page.withColumn("page", F.lit(len(pages))))
        last = end[0].asDict()
    return _shown(reduce(DataFrame.unionByName, pages, orders.limit(0).withColumn("page", F.lit(0))))


def _changed_orders(spark: SparkSession, sf_dir: str) -> tuple[BucketTable, dict[str, changes.Change]]:
    """``orders`` in buckets, after changes of one row, of many, a removal, and upserts by id and by key."""
    orders = _orders(spark, sf_dir)
    table = BucketTable(spark, scratch_path(spark, "orders"), orders.schema)
    table.write(orders, 1)
    o = load(spark, sf_dir, "orders")
    by_id = o.where(F.col("o_orderkey") % 40 == 0).select(
        F.lpad((F.col("o_orderkey") * 3).cast("string"), 24, "0").alias("id"), F.lit("N").alias("o_orderstatus"), "o_custkey"
    )
    by_key = o.where(F.col("o_custkey") % 50 == 1).select(
        (F.col("o_custkey") * 2).alias("o_custkey"), F.upper("o_orderpriority").alias("o_orderpriority"), F.lit(0.5).alias("o_totalprice")
    ).distinct()
    key = ["o_custkey", "o_orderpriority"]
    new_id = F.substring(F.sha2(F.concat_ws("/", *key), 256), 1, 24)
    done = {
        "one": changes.update_one(table, 2, F.col("o_orderpriority") == "2-HIGH", {"o_orderstatus": None}, STAMP),
        "many": changes.update_many(table, 3, F.col("o_custkey") % 30 == 7, {"o_totalprice": F.col("o_totalprice") * 2}, STAMP),
        "soft": changes.soft_delete(table, 4, F.col("o_custkey") == 11, STAMP),
        "removed": changes.delete_one(table, 5, F.col("o_orderpriority") == "5-LOW"),
        "by id": changes.upsert_by_id(table, 6, by_id, STAMP),
        "by key": changes.upsert(table, 7, by_key, key, STAMP, new_id),
        "none": changes.update_by_id(table, 8, "absent", {"o_totalprice": 1}, STAMP),
    }
    return table, done


def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_changed_orders(spark, sf_dir)[0].read())


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each change reports; counts come from the rows as they are written."""
    done = _changed_orders(spark, sf_dir)[1]
    found = [(what, c.modified, c.inserted, c.deleted, len(c.buckets) == 1) for what, c in done.items()]
    return spark.createDataFrame(found, "what string, modified long, inserted long, deleted long, one_bucket boolean")


def insert_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    old = F.when(F.col("p_partkey") % 3 == 0, F.lit(MID_JANUARY))
    items = part.select(
        F.lpad(F.col("p_partkey").cast("string"), 24, "0").alias("id"),
        old.alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.col("p_name").alias("name"),
        F.to_json(F.struct("p_brand", "p_size")).alias("properties"),
    )
    warehouse = Warehouse(spark, scratch_path(spark, "types"))
    warehouse.insert("types", items, 1, STAMP)
    return _shown(warehouse.read_appended("types"))


def update_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = F.col("o_orderpriority") == "1-URGENT"
    values = {"o_orderstatus": "U", "o_totalprice": F.col("o_totalprice") * 2, "id": "x"}
    return _shown(updates.update_many(_orders(spark, sf_dir), cond, values, STAMP))


def update_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = F.col("o_orderpriority") == "2-HIGH"
    return _shown(updates.update_one(_orders(spark, sf_dir), cond, {"o_orderstatus": None}, STAMP))


def modified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    urgent, absent = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "none"
    parts = [
        (name, updates.modified_count(orders, cond, one))
        for name, cond, one in (("many", urgent, False), ("one", urgent, True), ("none", absent, True))
    ]
    out = [df.select(F.lit(name).alias("what"), "modified") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = F.col("s_nationkey") % 2 == 0
    return _shown(updates.soft_delete(_suppliers(spark, sf_dir), cond, STAMP))


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _suppliers(spark, sf_dir)
    rest = updates.delete_one(suppliers, F.col("s_nationkey") > 10)
    return _shown(updates.delete_by_id(rest, "0" * 23 + "7"))


def structure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys shared by several rows: only the first row of a key changes, of several items the last wins."""
    customers = _customers(spark, sf_dir)
    source = load(spark, sf_dir, "customer")
    balance = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1)
    known = source.where(F.col("c_nationkey") % 2 == 0).select(
        "c_nationkey", "c_mktsegment", F.upper("c_name").alias("c_name"), balance.alias("c_acctbal"), "c_custkey"
    )
    fresh = source.where(F.col("c_nationkey") % 5 == 1).select(
        (F.col("c_nationkey") + 100).alias("c_nationkey"), "c_mktsegment", "c_name",
        F.col("c_acctbal"), "c_custkey",
    )
    key = ["c_nationkey", "c_mktsegment"]
    new_id = F.substring(F.sha2(F.concat_ws("/", *key), 256), 1, 24)
    items = known.unionByName(fresh)
    return _shown(updates.upsert(customers, items, key, STAMP, new_id, order="c_custkey"))


def upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = load(spark, sf_dir, "customer")
    items = source.select(
        F.lpad((F.col("c_custkey") * 2).cast("string"), 24, "0").alias("id"),
        "c_nationkey", "c_mktsegment", F.lit("new").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal"),
    )
    return _shown(updates.upsert_by_id(_customers(spark, sf_dir), items, STAMP))


def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = load(spark, sf_dir, "customer")
    items = source.select(
        F.lpad((F.col("c_custkey") * 2).cast("string"), 24, "0").alias("id"), "c_name"
    )
    return updates.upsert_counts(_customers(spark, sf_dir), items, ["id"])


# Gate and cursor

def _gate_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A catalog with cursors before, after and without relation to its samples."""
    records = log_records(spark, sf_dir)
    samples = conform(
        accepted(records).withColumn("created_at", F.col("event_at")), "sample_requests"
    )
    path = F.col("path")
    cursor = (
        F.when(path.contains("private"), F.lit(MID_JANUARY))
        .when(path.contains("uuid"), F.lit(None))
        .otherwise(F.lit(MARCH))
    )
    apis = catalog.new_apis(catalog.discover_apis(records), empty_table(spark, "apis"), NOW)
    return apis.withColumn("latest_build_structure", cursor), samples


def _rollups(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """What ingests of the samples in three batches leave for the gates."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    for batch in range(3):
        part = samples.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch)
        append_samples(warehouse, part, empty_table(spark, "sample_responses"), batch + 1, NOW)
    return read_rollups(warehouse)


def newest_per_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples = _gate_input(spark, sf_dir)
    return gate.newest_in_rollups(_rollups(spark, samples), "request").select("api_id", _micros("newest"))


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples = _gate_input(spark, sf_dir)
    start, end = datetime(2024, 1, 10, tzinfo=timezone.utc), MID_JANUARY
    return samples.where(gate.created_between(start, end)).select("id", _micros("created_at"))


def stale_apis(spark: SparkSession, sf_dir: str) -> DataFrame:
    apis, samples = _gate_input(spark, sf_dir)
    newest = gate.newest_in_rollups(_rollups(spark, samples), "request")
    due = [
        gate.due_by_newest(apis, newest, g).select(F.lit(g).alias("gate"), "api_id", _micros("cursor"))
        for g in gate.GATES
    ]
    return due[0].unionByName(due[1])


def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    apis, samples = _gate_input(spark, sf_dir)
    window = gate.window_samples(samples, gate.due_apis(apis, samples))
    return window.groupBy("api_id").agg(F.count("*").alias("n"), F.unix_micros(F.min("created_at")).alias("first"))


def cursor_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    apis, samples = _gate_input(spark, sf_dir)
    moved = gate.advance_cursor(apis, gate.due_apis(apis, samples), STAMP)
    return moved.select("id", _micros("latest_build_structure"), _micros("updated_at"), _micros("created_at"))


# Whole jobs

def openapi_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    apis = catalog.new_apis(catalog.discover_apis(records), empty_table(spark, "apis"), NOW)
    built = build_structures(
        apis,
        catalog.request_samples(records, NOW),
        catalog.response_samples(records, NOW),
        empty_table(spark, "request_structures"),
        empty_table(spark, "response_structures"),
        STAMP,
    )
    return api_documents(built.apis, built.request_structures, built.response_structures)


def build_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From compressed files to documents, through the tables."""
    root = scratch_path(spark, "archive")
    write_archive(log_lines(load(spark, sf_dir, "events")), root)
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    ingest_archive(spark, root, *_span(spark, sf_dir), warehouse, NOW, batch=1)
    run_build(warehouse, STAMP, version=3)
    return load_documents(warehouse)


def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of log files; each run of the stream takes up what is new."""
    root, checkpoint = scratch_path(spark, "incoming"), scratch_path(spark, "stream")
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    lines = stage(log_lines(load(spark, sf_dir, "events")), "lines")
    for part in range(3):
        arrival = lines.where(F.col("event_id") % 3 == part).select("value")
        arrival.write.mode("append").option("compression", "gzip").text(f"{root}/arrival={part}")
        run_incremental(spark, root, warehouse, checkpoint, NOW)
    return load_documents(warehouse)


def refreshed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after two ingests of unlike APIs, each with the version that rendered it: the second leaves the first's alone."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    late = F.col("event_type") == "purchase"
    kinds = load(spark, sf_dir, "events").select("event_id", late.alias("late"))
    lines = stage(log_lines(load(spark, sf_dir, "events")).join(kinds, "event_id"), "lines")
    for batch, part in enumerate((~F.col("late"), F.col("late")), start=1):
        now = NOW + timedelta(hours=batch)
        ingest_lines(lines.where(part).select("file", "value"), warehouse, now, batch)
        run_build(warehouse, now, version=2 * batch + 1)
        documents = refresh_documents(warehouse, 2 * batch + 1)
    return documents.drop("mark")


def _arrive(lines: DataFrame, folder: str) -> None:
    lines.select("value").write.option("compression", "gzip").text(folder)


def late_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that turn up with a time long before those already taken up."""
    root, checkpoint = scratch_path(spark, "incoming"), scratch_path(spark, "stream")
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    lines = stage(log_lines(load(spark, sf_dir, "events")), "lines")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for part in range(2):
        folder = f"{root}/arrival={part}"
        _arrive(lines.where(F.col("event_id") % 2 == part), folder)
        fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(hadoop.Path(folder)) if part else []:
            fs.setTimes(status.getPath(), 1_000_000_000_000, -1)
        run_incremental(spark, root, warehouse, checkpoint, NOW)
    return load_documents(warehouse)


def incremental_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals in order of time under 'oldest' precedence: the same documents as from one build."""
    root, checkpoint = scratch_path(spark, "incoming"), scratch_path(spark, "stream")
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    lines = stage(log_lines(load(spark, sf_dir, "events")), "lines")
    low, high = lines.agg(F.percentile_approx(F.col("ts").cast("long"), [0.3, 0.7])).first()[0]
    part = F.when(F.col("ts").cast("long") <= low, 0).when(F.col("ts").cast("long") <= high, 1).otherwise(2)
    for arrival in range(3):
        _arrive(lines.where(part == arrival), f"{root}/arrival={arrival}")
        run_incremental(spark, root, warehouse, checkpoint, NOW, precedence="oldest")
    return load_documents(warehouse)


def arrival_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log dealt out over batches in three ways that have nothing to do with time, each built batch by batch."""
    lines = stage(log_lines(load(spark, sf_dir, "events")), "lines")

    def built(order: int) -> DataFrame:
        warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
        part = F.pmod(F.xxhash64("event_id", F.lit(order)), F.lit(2))
        for batch in range(1, 3):
            now = NOW + timedelta(hours=batch)
            ingest_lines(lines.where(part == (batch + order) % 2).select("file", "value"), warehouse, now, batch)
            run_build(warehouse, now, version=2 * batch + 1, precedence="event")
        return load_documents(warehouse).withColumn("arrival_order", F.lit(order))

    # Side by side: the many short jobs of one order leave cores to the others.
    with ThreadPoolExecutor(3) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(built), range(3)))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    lines = stage(log_lines(load(spark, sf_dir, "events")), "lines")
    return [lines.where(F.col("event_id") % 2 == part).select("file", "value") for part in range(2)]


def overlapping_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch written after a build, with an earlier stamp than that build's."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    first, second = _halves(spark, sf_dir)
    ingest_lines(first, warehouse, NOW, 1)
    run_build(warehouse, NOW + timedelta(seconds=100), version=3)
    ingest_lines(second, warehouse, NOW + timedelta(seconds=50), 2)
    run_build(warehouse, NOW + timedelta(seconds=200), version=5)
    return load_documents(warehouse)


def same_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest and build of a batch under one instant, as README shows it, for one batch and another."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    for batch, lines in enumerate(_halves(spark, sf_dir), start=1):
        now = NOW + timedelta(hours=batch)
        ingest_lines(lines, warehouse, now, batch)
        run_build(warehouse, now, version=2 * batch + 1)
    return load_documents(warehouse)


def rebuild_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response structures of a build, soft-deleted, and their successors from another half of the log."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    first, second = _halves(spark, sf_dir)
    ingest_lines(first, warehouse, NOW, 1)
    run_build(warehouse, NOW, version=3)
    for table in ("request_structures", "response_structures"):
        gone = updates.soft_delete(warehouse.read_snapshot(table), F.lit(True), NOW + timedelta(hours=1))
        warehouse.write_snapshot(table, gone, 4)
    ingest_lines(second, warehouse, NOW + timedelta(hours=2), 2)
    run_build(warehouse, NOW + timedelta(hours=2), version=5)
    rows_ = warehouse.read_snapshot("response_structures")
    names = F.json_object_keys(F.get_json_object("body_schema", "$.properties"))
    return rows_.groupBy("api_id").agg(
        F.count_if(F.col("deleted_at").isNull()).alias("n_live"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"),
        F.countDistinct("id").alias("n_ids"),
        F.array_join(F.sort_array(F.coalesce(F.max(F.when(F.col("deleted_at").isNull(), names)), F.array())), ",").alias("live_keys"),
    )


QUERIES = {
    "hour_paths": hour_folders,
    "folder_scan": folder_scan,
    "damaged_files": damaged_files,
    "late_files": late_files,
    "incremental_oldest": incremental_oldest,
    "arrival_orders": arrival_orders,
    "refreshed_documents": refreshed_documents,
    "overlapping_ingest": overlapping_ingest,
    "same_stamps": same_stamps,
    "rebuild_after_delete": rebuild_after_delete,
    "schema_merge_deep": schema_merge_deep,
    "gz_scan": gz_scan,
    "clean_lines": clean_lines,
    "record_validity": record_validity,
    "quarantine_lines": quarantine_lines,
    "url_split": url_split,
    "path_template": path_templates,
    "param_rows": parameter_rows,
    "api_catalog": api_catalog,
    "request_samples": request_samples,
    "response_samples": response_samples,
    "param_merge": param_merge,
    "schema_fields_request": schema_fields(catalog.request_samples),
    "schema_fields_response": schema_fields(catalog.response_samples),
    "body_counts": body_counts,
    "rejected_bodies": rejected_bodies,
    "schema_merge_pair": schema_merge_pair,
    "find_rows": find_rows,
    "page_live_rows": page_live_rows,
    "far_page": far_page,
    "page_chain": page_chain,
    "bucket_rows": bucket_rows,
    "bucket_counts": bucket_counts,
    "api_page": api_page,
    "first_match": first_match,
    "count_rows": count_rows,
    "valid_inputs": valid_inputs,
    "insert_stamped": insert_stamped,
    "update_many": update_many,
    "update_first": update_first,
    "modified_counts": modified_counts,
    "soft_delete": soft_delete,
    "delete_rows": delete_rows,
    "structure_upsert": structure_upsert,
    "upsert_by_id": upsert_by_id,
    "upsert_counts": upsert_counts,
    "newest_per_api": newest_per_api,
    "time_range": time_range,
    "stale_apis": stale_apis,
    "window_samples": window_samples,
    "cursor_moves": cursor_moves,
    "openapi_docs": openapi_docs,
    "build_all": build_all,
    "incremental_build": incremental_build,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def with_settings(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(configure(spark), sf_dir)

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        return run

    return {name: with_settings(query) for name, query in QUERIES.items()}
