"""OpenAPI documents: one row per API."""

import json

from pyspark.sql import Column, DataFrame, functions as F

from specloom.functions.json_values import quoted
from specloom.operators.gate import live
from specloom.operators.parameter_merge import document_parameters
from specloom.operators.schema_fold import EMPTY_SCHEMA

# Fixed values of every document.
OPENAPI_VERSION = "3.0.0"
DOCUMENT_VERSION = "1.0.0"
PRIVATE_MARKER = "private"
SUCCESS_STATUS, SUCCESS_TEXT = "200", "Success"
SECURITY = [{"Bearer": []}]
SECURITY_DEFINITIONS = {
    "Bearer": {
        "description": 'Enter the token with the `Bearer: ` prefix, e.g. "Bearer abcde12345".',
        "in": "header",
        "name": "Authorization",
        "type": "apiKey",
    }
}


def _compact(value) -> str:
    return json.dumps(value, separators=(",", ":"))


def is_private(path: Column) -> Column:
    return path.contains(PRIVATE_MARKER)


def _content(schema: Column) -> Column:
    """The content section of a body; null for a missing or empty schema."""
    return F.when(
        schema != EMPTY_SCHEMA,
        F.concat(F.lit('{"application/json":{"schema":'), schema, F.lit("}}")),
    )


def request_body(schema: Column) -> Column:
    return F.concat(F.lit('{"content":'), _content(schema), F.lit("}"))


def responses(schema: Column) -> Column:
    return F.concat(
        F.lit(f'{{"{SUCCESS_STATUS}":{{"content":'),
        _content(schema),
        F.lit(f',"description":"{SUCCESS_TEXT}"}}}}'),
    )


def operation(path: Column, parameters: Column, request_schema: Column, response_schema: Column) -> Column:
    """The operation object; sections without content are left out."""
    sections = {
        "parameters": document_parameters(parameters),
        "requestBody": request_body(request_schema),
        "responses": responses(response_schema),
        "security": F.when(is_private(path), F.lit(_compact(SECURITY))),
    }
    named = [F.concat(F.lit(f'"{name}":'), text) for name, text in sections.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def document(operation_text: Column, title: str, description: str) -> Column:
    info = {"title": title, "description": description, "version": DOCUMENT_VERSION}
    return F.concat(
        F.lit(f'{{"openapi":"{OPENAPI_VERSION}","info":{_compact(info)},"servers":[{{"url":'),
        quoted(F.coalesce("host", F.lit(""))),
        F.lit('}],"paths":{'),
        quoted(F.col("path")),
        F.lit(":{"),
        quoted(F.lower(F.coalesce("method", F.lit("")))),
        F.lit(":"),
        operation_text,
        F.lit(f'}}}},"securityDefinitions":{_compact(SECURITY_DEFINITIONS)}'),
        F.lit(f',"security":{_compact(SECURITY)}}}'),
    )


def _single(structures: DataFrame, columns: list[str]) -> DataFrame:
    """The first live structure per API."""
    return live(structures).groupBy("api_id").agg(
        F.min_by(F.struct(*columns), F.struct("created_at", "id")).alias("s")
    )


def document_inputs(apis: DataFrame, request_structures: DataFrame, response_structures: DataFrame) -> DataFrame:
    """All that the document of each live API is made of; null where a structure is missing."""
    req = _single(request_structures, ["parameters", "body_schema"]).select(
        "api_id", "s.parameters", F.col("s.body_schema").alias("request_schema")
    )
    resp = _single(response_structures, ["body_schema"]).select(
        "api_id", F.col("s.body_schema").alias("response_schema")
    )
    return (
        live(apis)
        .select(F.col("id").alias("api_id"), "host", "path", "method")
        .join(req, "api_id", "left")
        .join(resp, "api_id", "left")
    )


def api_documents(
    apis: DataFrame,
    request_structures: DataFrame,
    response_structures: DataFrame,
    title: str = "API document",
    description: str = "API document",
) -> DataFrame:
    """(api_id, path, method, document) for every live API; a missing structure drops its section.

    Filter on ``api_id`` for one API: the filter reaches all three scans, and an empty
    result means the API is not known.
    """
    joined = document_inputs(apis, request_structures, response_structures)
    op = operation(
        F.col("path"), F.col("parameters"), F.col("request_schema"), F.col("response_schema")
    )
    return joined.select(
        "api_id", "path", "method", document(op, title, description).alias("document")
    )
