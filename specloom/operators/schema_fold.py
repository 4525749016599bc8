"""Fold of sample bodies into one schema per API, and the merge of two schemas.

The fold looks recursive but decides each top-level key as a whole: of all samples whose
value for the key says something, the oldest one provides the key's schema, and any sample
beats what is stored. So the big input is parsed once and exploded by key, without values,
to a hashed minimum of the event time, combined before the shuffle. Only the samples of
those times are parsed again for their values; nested schemas are inferred for the winners
only.
"""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from specloom.functions.json_values import (
    as_array, as_object, producing_members, quoted, shape, with_strict_json,
)
from specloom.operators.schema_infer import infer_schemas
from specloom.session import settled, ship_package, stage

EMPTY_SCHEMA = "{}"
_ENTRY = "array<struct<kind:string,key:string,value:string>>"


def _entry(kind: str, key=None, value=None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(None) if key is None else key).cast("string").alias("key"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
    )


def body_entries(body: Column, members: Column, values: bool = True) -> Column:
    """A parsed body as entries: 'body' once if accepted, then 'key' per telling member, if asked with its value.

    ``members`` is the body's member map, null unless it is an object. An array or null is a
    body without members; a scalar, or text that is not one JSON value (null here), is
    'rejected'.
    """
    telling = producing_members(members)
    if values:
        keys = F.transform(F.map_entries(telling), lambda e: _entry("key", e["key"], shape(e["value"])))
    else:
        keys = F.transform(F.map_keys(telling), lambda key: _entry("key", key))
    return (
        F.when(members.isNotNull(), F.concat(F.array(_entry("body")), keys))
        .when(F.is_variant_null(body) | as_array(body).isNotNull(), F.array(_entry("body")))
        .otherwise(F.array(_entry("rejected")))
        .cast(_ENTRY)
    )


def _parsed_bodies(samples: DataFrame, *columns: str) -> DataFrame:
    """Non-empty bodies as ``_body``, with the member map of objects as ``_members``."""
    bodies = samples.where(F.col("body") != "").select(*columns, "body")
    parsed = with_strict_json(bodies, "body", "_body")
    return parsed.withColumn("_members", as_object(F.col("_body")))


def fold_bodies(samples: DataFrame, by: list[str]) -> DataFrame:
    """Oldest telling value per (``by``, key), with its sample's time and id, plus 'body' and 'rejected' counts per ``by``.

    ``samples`` has the ``by`` columns, ``id``, ``event_at`` and ``body``. Every body is
    parsed in one pass and one shuffle; a hot API leaves each task as one row per key. Rows
    of equal event times are ordered by id, in a second pass over the oldest samples.
    """
    counted = stage(oldest_entries(samples, by), "oldest")
    oldest = counted.where(F.col("kind") == "key").select(*by, "key", "event_at")
    first = samples.join(oldest.select(*by, "event_at").distinct(), [*by, "event_at"], "left_semi")
    entries = _entries(first, by).select(*by, "event_at", "id", "e.key", "e.value")
    values = (
        entries.join(oldest, [*by, "key", "event_at"], "left_semi")
        .groupBy(*by, "key")
        .agg(F.min_by("value", "id").alias("value"), F.min("id").alias("id"))
    )
    return counted.join(values, [*by, "key"], "left")


def _entries(samples: DataFrame, by: list[str]) -> DataFrame:
    parsed = _parsed_bodies(samples, *by, "event_at", "id")
    return parsed.select(
        *by, "event_at", "id", F.explode(body_entries(F.col("_body"), F.col("_members"))).alias("e")
    )


def _entry_names(samples: DataFrame, by: list[str]) -> DataFrame:
    """Kinds and keys alone: no values are shaped for a pass over all samples that drops them."""
    parsed = _parsed_bodies(samples, *by, "event_at")
    entries = body_entries(F.col("_body"), F.col("_members"), values=False)
    return parsed.select(*by, "event_at", F.explode(entries).alias("e"))


def oldest_entries(samples: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, kind, key, event_at, n): the oldest time and number of each kind of entry, by hashing alone."""
    return (
        _entry_names(samples, by)
        .select(*by, "e.kind", "e.key", "event_at")
        .groupBy(*by, "kind", "key")
        .agg(F.min("event_at").alias("event_at"), F.count("*").alias("n"))
    )


def rejected_bodies(samples: DataFrame) -> DataFrame:
    """Quarantine rows for the bodies the fold rejects; ``side`` tells whose body it is."""
    parsed = settled(_parsed_bodies(samples, "side"))
    accepted = (
        F.col("_members").isNotNull()
        | as_array(F.col("_body")).isNotNull()
        | F.is_variant_null("_body")
    )
    return parsed.where(~F.coalesce(accepted, F.lit(False))).select(
        F.lit(None).cast("string").alias("file"),
        F.col("body").alias("line"),
        F.concat("side", F.lit(" body")).alias("stage"),
        F.lit("body is not a JSON object, array or null").alias("reason"),
    )


def winning_schemas(folded: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, key, schema, fields) of a fold's winners."""
    return infer_schemas(folded.where(F.col("kind") == "key").select(*by, "key", "value"))


def merge_schemas(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Merge two sets of (``by``, key, schema): the right side wins a shared key.

    An empty schema on the right leaves the left one (or nothing); a null on the left is
    dropped, a null on the right wins.
    """
    l = left.select(*by, "key", F.nullif(F.col("schema"), F.lit("null")).alias("_left"))
    r = right.select(*by, "key", F.nullif(F.col("schema"), F.lit(EMPTY_SCHEMA)).alias("_right"))
    merged = l.join(r, [*by, "key"], "full_outer")
    return merged.select(
        *by, "key", F.coalesce("_right", "_left").alias("schema")
    ).where(F.col("schema").isNotNull())


def merge_deep(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """As :func:`merge_schemas`, but two object schemas of a key are merged member by member, at any depth.

    Arrays of objects are merged by their items. Only keys that both sides have come together in a row.
    """
    ship_package(left.sparkSession)

    @F.pandas_udf("string")
    def merged(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        return pd.Series([_merged_text(a, b) for a, b in zip(lefts, rights)], dtype=object)

    l = left.select(*by, "key", F.nullif(F.col("schema"), F.lit("null")).alias("_left"))
    r = right.select(*by, "key", F.nullif(F.col("schema"), F.lit(EMPTY_SCHEMA)).alias("_right"))
    joined = l.join(r, [*by, "key"], "full_outer")
    both = joined.where("_left IS NOT NULL AND _right IS NOT NULL").select(*by, "key", merged("_left", "_right").alias("schema"))
    one = joined.where("_left IS NULL OR _right IS NULL").select(*by, "key", F.coalesce("_right", "_left").alias("schema"))
    return both.unionByName(one.where(F.col("schema").isNotNull()))


def _merged_text(left: str, right: str) -> str:
    def merge(a, b):
        if not isinstance(a, dict) or not isinstance(b, dict) or a.get("type") != b.get("type"):
            return b
        if "properties" in a and "properties" in b:
            p, q = a["properties"], b["properties"]
            return {"properties": {k: merge(p[k], q[k]) if k in p and k in q else q.get(k, p.get(k)) for k in sorted({*p, *q})}, "type": b["type"]}
        if "items" in a and "items" in b:
            return {"items": merge(a["items"], b["items"]), "type": b["type"]}
        return b

    return json.dumps(merge(json.loads(left), json.loads(right)), separators=(",", ":"), ensure_ascii=False)


def merge_folds(state: DataFrame, folded: DataFrame, by: list[str]) -> DataFrame:
    """Next state (``by``, key, event_at, id, schema): per key what the oldest sample decides, of all builds so far.

    ``state`` is an earlier result, ``folded`` one of :func:`fold_bodies` over other samples. The least of (time, id) does
    not depend on which samples came together, nor in which order, so any sequence of builds over the same samples ends
    in the same state. Only winners that beat the state have their schemas inferred. A null time is older than all.
    """
    new = folded.where(F.col("kind") == "key").select(*by, "key", "event_at", "id", "value")
    held = state.select(*by, "key", F.struct("event_at", "id").alias("_held"))
    ahead = F.col("_held").isNull() | (F.struct("event_at", "id") < F.col("_held"))
    # Staged: what is inferred and what is replaced must be the same rows.
    ahead = stage(new.join(held, [*by, "key"], "left").where(ahead).drop("_held"), "ahead")
    inferred = infer_schemas(ahead).select(*by, "key", "event_at", "id", "schema")
    return state.join(ahead.select(*by, "key"), [*by, "key"], "left_anti").select(*inferred.columns).unionByName(inferred)


def stored_keys(structures: DataFrame, by: list[str]) -> DataFrame:
    """Top-level keys of stored body schemas as (``by``, key, schema)."""
    properties = F.try_variant_get(
        F.parse_json("body_schema"), "$.properties", "map<string,variant>"
    )
    return structures.select(
        *by, F.explode(F.transform_values(properties, lambda _, v: F.to_json(v))).alias("key", "schema")
    )


def render_bodies(keys: DataFrame, by: list[str]) -> DataFrame:
    """One object schema per ``by`` from its (key, schema) rows."""
    members = F.array_sort(F.collect_list(F.struct("key", "schema")))
    return keys.groupBy(*by).agg(members.alias("_members")).select(
        *by,
        object_schema(
            F.array_join(
                F.transform(
                    "_members", lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["schema"])
                ),
                ",",
            )
        ).alias("body_schema"),
    )


def object_schema(members: Column) -> Column:
    return F.concat(F.lit('{"properties":{'), members, F.lit('},"type":"object"}'))
