"""Build job: samples since the cursor to request and response structures, for all APIs at once."""

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from specloom.operators.catalog import first_sightings, with_first_sighting
from specloom.operators.gate import (
    UNREAD, advance_cursor, created_between, due_by_newest, live, newest_in_rollups, rollup_samples,
    unmatched_ids, window_samples,
)
from specloom.operators.parameter_merge import merge_parameters
from specloom.operators.schema_fold import (
    EMPTY_SCHEMA, fold_bodies, merge_deep, merge_folds, merge_schemas, object_schema, rejected_bodies,
    render_bodies, stored_keys, winning_schemas,
)
from specloom.operators.updates import upsert
from specloom.schemas import conform, empty_table
from specloom.session import configure, stage
from specloom.sources.tables import Warehouse

_BY = ["side", "api_id"]
REQUEST, RESPONSE = "request", "response"
# Which schema of a key stays when a build meets a stored one, and how two of them are merged. 'event' goes by the
# time of the samples that decided them, whichever build they came in.
EVENT = "event"
PRECEDENCES = ("newest", "oldest", EVENT)
MERGES = {"shallow": merge_schemas, "deep": merge_deep}


class Built(NamedTuple):
    apis: DataFrame
    request_structures: DataFrame
    response_structures: DataFrame
    quarantine: DataFrame
    folds: DataFrame


def body_schemas(
    due: DataFrame,
    window: DataFrame,
    stored: DataFrame,
    precedence: str = "newest",
    merge: str = "shallow",
    folds: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(side, api_id, body_schema, has_body, rejected) for every due side of an API; and the next ``folds``.

    Request and response bodies go through one pass. Without an accepted body, now or
    earlier, the schema is empty; with one it is at least an object without properties.

    ``folds`` is the state that the 'event' precedence keeps. A stored key that it does not
    know counts as older than all samples. The other precedences forget it for what they build.
    """
    if precedence not in PRECEDENCES or merge not in MERGES:
        raise ValueError(f"precedence must be one of {PRECEDENCES}, merge one of {tuple(MERGES)}")
    if precedence == EVENT and merge != "shallow":
        raise ValueError("by event time a key has the schema of one sample: there is nothing to merge")
    folds = empty_table(due.sparkSession, "folds") if folds is None else folds
    folded = stage(fold_bodies(window, _BY), "fold")
    counts = folded.where(F.col("kind") != "key").groupBy(*_BY).agg(
        F.max(F.col("kind") == "body").alias("_accepted"),
        F.sum(F.when(F.col("kind") == "rejected", F.col("n"))).alias("rejected"),
    )
    seed = stored.join(due.select(*_BY), _BY, "left_semi")
    built = due.select(*_BY)
    others = folds.join(built, _BY, "left_anti")
    if precedence == EVENT:
        # State of structures that are still there; of deleted ones it is forgotten.
        known = folds.join(seed.select(*_BY), _BY, "left_semi")
        untimed = stored_keys(seed, _BY).join(known, [*_BY, "key"], "left_anti")
        state = known.unionByName(conform(untimed, "folds"))
        keys = stage(conform(merge_folds(state, folded, _BY), "folds"), "folds")
        folds = others.unionByName(keys)
    else:
        sides = [stored_keys(seed, _BY), winning_schemas(folded, _BY)]
        keys = MERGES[merge](*(sides if precedence == "newest" else reversed(sides)), _BY)
        folds = others
    had_body = seed.select(*_BY, F.col("has_body").alias("_had"))
    accepted = F.coalesce("_accepted", F.lit(False)) | F.coalesce("_had", F.lit(False))
    schemas = (
        built.join(render_bodies(keys, _BY), _BY, "left")
        .join(counts, _BY, "left")
        .join(had_body, _BY, "left")
        .select(
            *_BY,
            F.coalesce(
                "body_schema",
                F.when(accepted, object_schema(F.lit(""))),
                F.lit(EMPTY_SCHEMA),
            ).alias("body_schema"),
            accepted.alias("has_body"),
            F.coalesce("rejected", F.lit(0)).alias("rejected"),
        )
    )
    return schemas, folds


def _both(request: DataFrame, response: DataFrame, *columns: str) -> DataFrame:
    """Rows of both sides with a ``side`` column."""
    return request.select(F.lit(REQUEST).alias("side"), *columns).unionByName(
        response.select(F.lit(RESPONSE).alias("side"), *columns)
    )


def _store(structures: DataFrame, items: DataFrame, side: str, now: datetime) -> DataFrame:
    """Upsert among live rows. A soft-deleted structure stays as it is, and its successor gets an id of its own."""
    stamp = F.unix_micros(F.lit(now)).cast("string")
    new_id = F.substring(F.sha2(F.concat_ws("/", F.lit(side), "api_id", stamp), 256), 1, 24)
    deleted = structures.where(F.col("deleted_at").isNotNull())
    return upsert(live(structures), items, ["api_id"], now, new_id).unionByName(deleted)


def build_structures(
    apis: DataFrame,
    sample_requests: DataFrame,
    sample_responses: DataFrame,
    request_structures: DataFrame,
    response_structures: DataFrame,
    now: datetime,
    gate: str = "fixed",
    precedence: str = "newest",
    merge: str = "shallow",
    folds: DataFrame | None = None,
    rollups: DataFrame | None = None,
) -> Built:
    """Next state of catalog and structures. The cursor of every live API moves to ``now``.

    With ``precedence='oldest'`` a stored schema of a key stays when a new one turns up, so
    builds over arrivals in order of time give what one build over all of them gives. With
    'event' they do so in any order: ``folds`` holds which sample decided each key. With
    ``merge='deep'`` object schemas of a key are merged member by member.

    ``rollups`` of the samples spare the gate their scan.
    """
    configure(apis.sparkSession)
    if rollups is None:
        rollups = rollup_samples(sample_requests, REQUEST).unionByName(rollup_samples(sample_responses, RESPONSE))
    # Staged: used several times, and as a plain small table it is what a join broadcasts.
    due = stage(
        _both(
            due_by_newest(apis, newest_in_rollups(rollups, REQUEST), gate),
            due_by_newest(apis, newest_in_rollups(rollups, RESPONSE), gate),
            "api_id",
            "cursor",
        ),
        "due",
    )
    due_req = due.where(F.col("side") == REQUEST).drop("side")
    due_resp = due.where(F.col("side") == RESPONSE).drop("side")
    window_req = window_samples(_since_oldest_cursor(sample_requests, due_req), due_req)
    window_resp = window_samples(_since_oldest_cursor(sample_responses, due_resp), due_resp)
    window = _both(window_req, window_resp, "api_id", "id", "event_at", "body")
    stored = _both(live(request_structures), live(response_structures), "api_id", "body_schema", "has_body")
    schemas, folds = body_schemas(due, window, stored, precedence, merge, folds)
    parameters = merge_parameters(
        live(request_structures).join(due_req, "api_id", "left_semi"), window_req, precedence != EVENT
    ).withColumn("side", F.lit(REQUEST))
    no_parameters = F.expr("array()").cast(request_structures.schema["parameters"].dataType)
    structures = stage(
        schemas.join(parameters, _BY, "left").withColumn(
            "parameters", F.coalesce("parameters", no_parameters)
        ),
        "structures",
    )

    def of(side: str) -> DataFrame:
        return structures.where(F.col("side") == side).drop("side", "rejected")

    return Built(
        advance_cursor(apis, live(apis).select(F.col("id").alias("api_id")), now),
        _store(request_structures, of(REQUEST), REQUEST, now),
        _store(response_structures, of(RESPONSE).drop("parameters"), RESPONSE, now),
        _rejected(structures, window),
        folds,
    )


def _since_oldest_cursor(samples: DataFrame, due: DataFrame) -> DataFrame:
    """Samples without those before every cursor, as a range the scan can prune by.

    One number passes the driver. If some API has no cursor, all samples may count.
    """
    oldest = due.agg(
        F.when(F.count_if(F.col("cursor").isNull()) == 0, F.unix_micros(F.min("cursor"))).alias("us")
    ).first().us
    if oldest is None:
        return samples
    return samples.where(created_between(F.timestamp_micros(F.lit(oldest))))


def _rejected(structures: DataFrame, window: DataFrame) -> DataFrame:
    """Quarantine of bodies; only APIs the fold found some in are read again."""
    some = structures.where(F.col("rejected") > 0).select(*_BY)
    return rejected_bodies(window.join(some, _BY, "left_semi"))


def run_build(
    warehouse: Warehouse,
    now: datetime,
    version: int,
    gate: str = UNREAD,
    precedence: str = "newest",
    merge: str = "shallow",
) -> None:
    """Build from the tables of a warehouse and write the next snapshots.

    ``version`` must exceed that of the catalog read. With ``precedence='event'`` any
    sequence of builds over the same batches ends in the same documents; host and method of
    the catalog then follow the first sighting too. By default the build takes up the
    batches that no earlier build has read, however their stamps and the builds' clocks
    compare, and no others are read; the gates that compare stamps read all batches. The
    list of batches read and the catalog are written last: a job that dies earlier is
    repeated in full.
    """
    apis = warehouse.read_snapshot("apis", below=version)
    batches = warehouse.batches("sample_responses")
    read = {r.batch for r in warehouse.read_snapshot("consumed", below=version).toLocalIterator()}
    wanted = [b for b in batches if b not in read] if gate == UNREAD else None
    if precedence == EVENT:
        # Without earlier state, the sightings of all batches are its beginning.
        earlier = warehouse.read_snapshot("first_seen", below=version)
        known = any(v < version for v in warehouse.versions("first_seen"))
        seen = warehouse.read_appended("sightings", wanted if known else None)
        first = stage(first_sightings(conform(seen, "first_seen").unionByName(earlier)), "first_seen")
        apis = with_first_sighting(apis, first)
    built = build_structures(
        apis,
        warehouse.read_appended("sample_requests", wanted),
        warehouse.read_appended("sample_responses", wanted),
        warehouse.read_snapshot("request_structures", below=version),
        warehouse.read_snapshot("response_structures", below=version),
        now,
        gate,
        precedence,
        merge,
        warehouse.read_snapshot("folds", below=version),
        read_rollups(warehouse, wanted),
    )
    if precedence == EVENT:
        warehouse.write_snapshot("first_seen", first, version)
    if precedence == EVENT or any(v < version for v in warehouse.versions("folds")):
        warehouse.write_snapshot("folds", built.folds, version)
    warehouse.write_snapshot("request_structures", built.request_structures, version)
    warehouse.write_snapshot("response_structures", built.response_structures, version)
    warehouse.append("quarantine", conform(built.quarantine, "quarantine"), version, now.date())
    consumed = warehouse.spark.createDataFrame([(b,) for b in sorted({*batches, *read})], "batch long")
    warehouse.write_snapshot("consumed", consumed, version)
    warehouse.write_snapshot("apis", built.apis, version)


def read_rollups(warehouse: Warehouse, batches: list[int] | None = None) -> DataFrame:
    """Rollups of the given batches' samples, or of all; batches written without one are rolled up from their samples."""
    there = warehouse.batches("sample_rollups")
    wanted = warehouse.batches("sample_responses") if batches is None else batches
    rollups = warehouse.read_appended("sample_rollups", [b for b in wanted if b in set(there)])
    bare = [b for b in wanted if b not in set(there)]
    for side, table in ((REQUEST, "sample_requests"), (RESPONSE, "sample_responses")) if bare else ():
        rollups = rollups.unionByName(rollup_samples(warehouse.read_appended(table, bare), side))
    return rollups


def move_cursor(apis: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """Move the cursor of the given ids; an id the catalog lacks, or a move that changes nothing, is an error."""
    if not unmatched_ids(apis, ids).isEmpty():
        raise LookupError("no documents found")
    asked = apis.join(ids.select(F.col("api_id").alias("id")), "id", "left_semi")
    there = F.col("latest_build_structure").eqNullSafe(F.lit(now)) & F.col("updated_at").eqNullSafe(F.lit(now))
    if asked.where(~there).isEmpty():
        raise LookupError("no documents modified")
    return advance_cursor(apis, ids, now)
