"""Document job: the documents of all APIs as a table, of those that changed, and the one of a single API."""

from pyspark.sql import DataFrame, functions as F

from specloom.operators.documents import api_documents, document_inputs
from specloom.session import stage
from specloom.sources.tables import Warehouse

_INPUTS = ("apis", "request_structures", "response_structures")


def load_documents(warehouse: Warehouse, **info: str) -> DataFrame:
    return api_documents(*[warehouse.read_snapshot(t) for t in _INPUTS], **info)


def refresh_documents(warehouse: Warehouse, version: int, **info: str) -> DataFrame:
    """Write the next snapshot of documents, rendering those alone that are new or were rendered from something else.

    A row's mark is a digest of all that its document is made of, title and description included; marks are compared by
    id, and only APIs whose marks differ are rendered. ``version`` is the one that they carry. Documents of APIs that are
    gone go too. The result equals :func:`load_documents`.
    """
    inputs = [warehouse.read_snapshot(t, below=version + 1) for t in _INPUTS]
    before = warehouse.read_snapshot("documents", below=version)
    said = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(info.items())])) if info else F.lit("")
    parts = document_inputs(*inputs)
    text = F.concat_ws("\n", said, F.to_json(F.struct(*parts.columns)))
    marks = stage(parts.select("api_id", F.sha2(text, 256).alias("mark")), "marks")
    fresh = stage(marks.join(before.select("api_id", "mark"), ["api_id", "mark"], "left_anti"), "fresh")
    ids = fresh.select("api_id")
    touched = [inputs[0].join(ids.withColumnRenamed("api_id", "id"), "id", "left_semi")]
    touched += [t.join(ids, "api_id", "left_semi") for t in inputs[1:]]
    rendered = api_documents(*touched, **info).join(fresh, "api_id").withColumn("version", F.lit(version).cast("bigint"))
    kept = before.join(marks, ["api_id", "mark"], "left_semi")
    columns = ["api_id", "path", "method", "document", "version", "mark"]
    warehouse.write_snapshot("documents", kept.select(*columns).unionByName(rendered.select(*columns)), version)
    return warehouse.read_snapshot("documents", below=version + 1)


def load_document(warehouse: Warehouse, api_id: str, **info: str) -> DataFrame:
    """The document of one API; no row means the API is not known."""
    if len(api_id) != 24 or any(c not in "0123456789abcdefABCDEF" for c in api_id):
        raise ValueError("an API id has 24 hexadecimal digits")
    return load_documents(warehouse, **info).where(F.col("api_id") == api_id.lower())
