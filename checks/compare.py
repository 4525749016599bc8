"""Run registered queries and their SQL side by side on the same tables."""

import datetime
import decimal
import sys
import tempfile
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql: str):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), _rows(columns, cursor.fetchall())


def difference(found, expected) -> str | None:
    """What differs between two results, or None."""
    if found[0] != expected[0]:
        return f"columns {found[0]} but SQL has {expected[0]}"
    if found[1] == expected[1]:
        return None
    extra = [r for r in found[1] if r not in set(expected[1])][:3]
    missing = [r for r in expected[1] if r not in set(found[1])][:3]
    return f"{len(found[1])} rows, SQL {len(expected[1])}; only here {extra}; only in SQL {missing}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from checks.oracle import SQL
    from checks.queries import registered
    from specloom.session import clear_scratch

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, query in registered().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = spark_result(query(spark, sf_dir))
            why = difference(found, sql_result(con, SQL[name])) if name in SQL else "no SQL"
            why = f"ok, {len(found[1])} rows" if why is None else f"DIFFERS: {why}"
        except Exception as error:  # noqa: BLE001 - report and go on
            why = f"DIFFERS: {type(error).__name__} {str(error)[:600]}"
        clear_scratch(spark)
        bad += why.startswith("DIFFERS")
        print(f"{name:24s} {time.time() - start:6.2f}s  {why}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
