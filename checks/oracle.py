"""SQL over the raw tables that states what each registered query must return."""

_NOW = "epoch_us(TIMESTAMP '2024-02-01')"
_STAMP = "epoch_us(TIMESTAMP '2024-06-01')"

_CLEAN = {
    7: "image content", 8: "gateway debug", 9: "gateway config",
    11: "bad escape", 12: "bad escape", 13: "bad escape",
}
_RECORD = {
    17: "invalid json", 29: "invalid json",
    18: "missing request info", 19: "request info is not a map", 20: "request info is not a map",
    21: "missing response info", 22: "response info is not a map",
    23: "url is not a string", 24: "method is not a string", 25: "request body is not a string",
    26: "querystring is not a map", 27: "querystring value is not a string",
    28: "response body is not a string",
}


def _case(key: str, cases: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in cases.items()) + f" ELSE {default} END"


_E = f"""
e AS (
  SELECT *, event_id % 100 AS h,
    event_type IN ('purchase', 'signup') AS w,
    substr(sha256(CAST(event_id AS VARCHAR)), 1, 24) AS sid,
    epoch_us(ts) // 1000 * 1000 AS us,
    lpad(CAST(epoch_us(ts) // 1000 AS VARCHAR), 15, '0') || sha256(CAST(event_id AS VARCHAR)) AS ord,
    '/v1/' || CASE WHEN event_type IN ('purchase', 'signup') THEN 'private/' ELSE '' END
      || event_type || '/' || CASE WHEN event_id % 10 = 4 THEN '{{uuid}}' ELSE '{{id}}' END
      || CASE WHEN event_id % 3 = 0 THEN ':confirm' ELSE '' END AS path,
    {_case("event_id % 100", _CLEAN, "''")} AS clean,
    {_case("event_id % 100", _RECORD, "''")} AS record
  FROM events),
a AS (SELECT *, substr(sha256(path), 1, 24) AS api_id,
        CASE WHEN w THEN 'POST' ELSE 'GET' END AS method
      FROM e WHERE clean = '' AND record = '')
"""


def _object(members: str) -> str:
    return '{"properties":{' + members + '},"type":"object"}'


def _deep() -> tuple[str, list[str]]:
    """Schema and nodes of the deep response body."""
    names = list("abcdefg")
    schema = '"g":{"items":' + _object('"h":{"type":"boolean"}') + ',"type":"array"}'
    for name in reversed(names[:-1]):
        schema = f'"{name}":' + _object(schema)
    nodes, path = ["deep|object|"], "deep"
    for name in names:
        path += f".{name}"
        nodes.append(f"{path}|array|object" if name == "g" else f"{path}|object|")
    return _object(schema), [*nodes, f"{path}.h|boolean|"]


_DEEP_SCHEMA, _DEEP_NODES = _deep()
_STRING, _NUMBER = '{"type":"string"}', '{"type":"number"}'


def _array_of(kind: str) -> str:
    return '{"items":{"type":"' + kind + '"},"type":"array"}'


# key, condition, schema, nodes under it
_RESPONSE_KEYS = [
    ("id", "b NOT IN (10, 12)", _NUMBER, ["id|number|"]),
    ("id", "b = 10", _STRING, ["id|string|"]),
    ("deep", "b = 12", _DEEP_SCHEMA, _DEEP_NODES),
    ("value", "b NOT IN (10, 12) AND event_id % 5 = 0", _STRING, ["value|string|"]),
    ("value", "b NOT IN (10, 12) AND event_id % 5 <> 0", _NUMBER, ["value|number|"]),
    ("error", "b NOT IN (10, 12) AND event_type = 'error'", _STRING, ["error|string|"]),
    ("user", "b NOT IN (10, 12) AND event_id % 2 = 0", _object('"id":{"type":"number"},"tier":{"type":"string"}'),
     ["user|object|", "user.id|number|", "user.tier|string|"]),
    ("user", "b NOT IN (10, 12) AND event_id % 2 = 1", _object('"flag":{"type":"boolean"},"id":{"type":"number"}'),
     ["user|object|", "user.id|number|", "user.flag|boolean|"]),
    ("tags", "b NOT IN (10, 12) AND event_id % 6 = 1", _array_of("string"), ["tags|array|string"]),
    ("tags", "b NOT IN (10, 12) AND event_id % 6 = 2", _array_of("number"), ["tags|array|number"]),
    ("tags", "b NOT IN (10, 12) AND event_id % 6 = 3",
     '{"items":' + _object('"x":{"type":"number"},"y":{"type":"string"}') + ',"type":"array"}',
     ["tags|array|object", "tags.x|number|", "tags.y|string|"]),
    ("tags", "b NOT IN (10, 12) AND event_id % 6 = 5", _array_of("array"), ["tags|array|array"]),
]

_RESPONSE_BODIES = """
rb AS (SELECT *, event_id % 23 AS b FROM a WHERE event_id % 11 <> 0 AND event_id % 13 <> 0),
ok AS (SELECT * FROM rb WHERE b NOT IN (5, 8, 9)),
tell AS (SELECT * FROM ok WHERE b NOT IN (6, 7))
"""
_RESPONSE_VALUES = "rv AS (" + " UNION ALL ".join(
    f"SELECT api_id, path, event_id, ord, '{key}' AS key, '{schema}' AS schema, '{';'.join(nodes)}' AS nodes "
    f"FROM tell WHERE {cond}"
    for key, cond, schema, nodes in _RESPONSE_KEYS
) + ")"


def _winners(order: str) -> str:
    return (
        f"win AS (SELECT path, api_id, key, arg_min(schema, {order}) AS schema, "
        f"arg_min(nodes, {order}) AS nodes FROM rv GROUP BY ALL)"
    )


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_NODES = """
n AS (SELECT path, string_split(unnest(string_split(nodes, ';')), '|') AS p FROM win)
SELECT path, p[1] AS field, p[2] AS type, p[3] AS items_type FROM n
"""

_PARAMETERS = """
p AS (
  SELECT a.* EXCLUDE (value), q.name, q.type, q.value FROM a, LATERAL (
    SELECT 'limit' AS name, 'integer' AS type, '20' AS value
    UNION ALL SELECT 'page', 'integer', CAST(a.event_id % 7 AS VARCHAR)
    UNION ALL SELECT 'q', 'string', 'x y' WHERE a.event_id % 4 = 0
    UNION ALL SELECT '1', 'boolean', 'on' WHERE a.event_id % 9 = 0
    UNION ALL SELECT '12', 'integer', 'z' WHERE a.event_id % 9 = 3) q)
"""


def _documents(order: str) -> str:
    head = (
        '{"openapi":"3.0.0","info":{"title":"API document","description":"API document",'
        '"version":"1.0.0"},"servers":[{"url":"gw.example.com"}],"paths":{'
    )
    tail = (
        ',"securityDefinitions":{"Bearer":{"description":"Enter the token with the `Bearer: ` prefix, e.g. \\"Bearer abcde12345\\".",'
        '"in":"header","name":"Authorization","type":"apiKey"}},"security":[{"Bearer":[]}]}'
    )
    request = '"requestBody":{"content":{"application/json":{"schema":' + _object(f'"k":{_NUMBER}') + "}}}"
    return _with(_E, _PARAMETERS, _RESPONSE_BODIES, _RESPONSE_VALUES, _winners(order)) + f"""
, api AS (SELECT DISTINCT api_id, path, method FROM a),
pl AS (SELECT api_id, string_agg('{{"in":"query","name":"' || name || '","required":false,"schema":{{"type":"' || type || '"}}}}', ',' ORDER BY name) AS l
       FROM (SELECT DISTINCT api_id, name, type FROM p) GROUP BY api_id),
rs AS (SELECT api_id, string_agg('"' || key || '":' || schema, ',' ORDER BY key) AS l FROM win GROUP BY api_id),
with_body AS (SELECT DISTINCT api_id FROM ok)
SELECT api.api_id, api.path, api.method,
  '{head}' || '"' || api.path || '":{{"' || lower(api.method) || '":{{"parameters":[' || pl.l || ']'
  || CASE WHEN api.method = 'POST' THEN ',{request}' ELSE '' END
  || CASE WHEN with_body.api_id IS NULL THEN '' ELSE
       ',"responses":{{"200":{{"content":{{"application/json":{{"schema":{{"properties":{{' || coalesce(rs.l, '')
       || '}},"type":"object"}}}}}},"description":"Success"}}}}' END
  || CASE WHEN api.path LIKE '%private%' THEN ',"security":[{{"Bearer":[]}}]' ELSE '' END
  || '}}}}}}{tail}' AS document
FROM api JOIN pl USING (api_id) LEFT JOIN rs USING (api_id) LEFT JOIN with_body USING (api_id)
"""


_ORDERS = """
o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 24, '0') AS id, epoch_us(o_orderdate) AS created_at,
        epoch_us(o_orderdate) AS updated_at,
        CASE WHEN o_orderkey % 7 = 0 THEN epoch_us(o_orderdate) + 86400000000 END AS deleted_at,
        o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)
"""
_CUSTOMERS = """
c AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 24, '0') AS id,
        epoch_us(TIMESTAMP '2024-01-15') + c_custkey % 10 * 86400000000 AS created_at,
        c_nationkey, c_mktsegment, c_name, c_acctbal FROM customer)
"""
_SUPPLIERS = """
s AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 24, '0') AS id,
        epoch_us(TIMESTAMP '2024-01-15') + s_suppkey % 10 * 86400000000 AS created_at,
        s_nationkey, s_name, s_acctbal FROM supplier)
"""
_CURSORS = """
g AS (SELECT api_id, path, max(us) AS newest,
        CASE WHEN path LIKE '%private%' THEN epoch_us(TIMESTAMP '2024-01-15')
             WHEN path LIKE '%uuid%' THEN NULL ELSE epoch_us(TIMESTAMP '2024-03-01') END AS cursor
      FROM a GROUP BY ALL)
"""


SQL = {
    "hour_paths": """
        SELECT 'logs/proxy/' || strftime(unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)), '%Y-%m-%d/%H') || '/' AS folder
        FROM events""",
    "gz_scan": _with(_E) + """
        SELECT 'logs/proxy/' || strftime(ts, '%Y-%m-%d/%H') || '/' AS folder, count(*) AS n_lines,
          count(*) FILTER (WHERE clean = '' AND record = '') AS n_accepted, 1 AS n_files
        FROM e GROUP BY 1""",
    "record_validity": _with(_E) + """
        SELECT CASE WHEN clean <> '' THEN 'clean' WHEN record <> '' THEN 'record' ELSE '' END AS stage,
          CASE WHEN clean <> '' THEN clean ELSE record END AS reason, count(*) AS n,
          count(*) FILTER (WHERE clean <> '' OR record <> '') AS n_lines
        FROM e GROUP BY 1, 2""",
    "quarantine_lines": _with(_E) + """
        SELECT 'events' AS file, CASE WHEN clean <> '' THEN 'clean' ELSE 'record' END AS stage,
          CASE WHEN clean <> '' THEN clean ELSE record END AS reason,
          CASE WHEN max(h) = 29 THEN 2 ELSE count(*) END AS n
        FROM e WHERE clean <> '' OR record <> '' GROUP BY 2, 3""",
    "url_split": """
        SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host,
          replace(url_decode(replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '+', '%2B')), '%2B', '+') AS path
        FROM pages""",
    "path_template": _with(_E) + """
        SELECT 'page' AS source, CAST(page_id AS VARCHAR) AS id,
          list_aggregate(list_transform(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'),
            lambda s: CASE WHEN regexp_full_match(s, '[+-]?[0-9]{1,18}') THEN '{id}' ELSE s END), 'string_agg', '/') AS template
        FROM pages UNION ALL SELECT 'log', sid, path FROM a""",
    "param_rows": _with(_E, _PARAMETERS) + """
        SELECT sid AS id, name, type, value, 'query' AS "in", false AS required FROM p""",
    "api_catalog": _with(_E) + f"""
        SELECT api_id AS id, 'gw.example.com' AS host, path, arg_min(method, ord) AS method,
          CASE WHEN path LIKE '%view%' THEN {_NOW} ELSE {_STAMP} END AS created_at
        FROM a GROUP BY ALL""",
    "request_samples": _with(_E, _PARAMETERS) + f"""
        SELECT sid AS id, api_id, CASE WHEN w THEN props ELSE '' END AS body, count(*) AS n_parameters,
          {_NOW} AS created_at, us AS event_at FROM p GROUP BY ALL""",
    "param_merge": _with(_E, _PARAMETERS) + """,
        u AS (SELECT path, name, type, false AS required FROM p
              UNION ALL SELECT path, 'page', CASE WHEN w THEN 'string' ELSE 'integer' END, true FROM a
              UNION ALL SELECT path, 'old', 'any', false FROM a)
        SELECT path, name, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'any' END AS type,
          '' AS value, 'query' AS "in", name = 'page' AS required
        FROM u GROUP BY path, name""",
    "schema_fields_request": _with(_E) + """
        SELECT DISTINCT path, 'k' AS field, 'number' AS type, '' AS items_type FROM a WHERE w""",
    "schema_fields_response": _with(_E, _RESPONSE_BODIES, _RESPONSE_VALUES, _winners("ord")) + "," + _NODES,
    "body_counts": _with(_E, _RESPONSE_BODIES) + """
        SELECT path, CASE WHEN b IN (5, 8, 9) THEN 'rejected' ELSE 'body' END AS kind, count(*) AS n
        FROM rb GROUP BY 1, 2""",
    "rejected_bodies": _with(_E, _RESPONSE_BODIES) + """
        SELECT CASE b WHEN 5 THEN '{"id":1} x' WHEN 8 THEN '3' ELSE '{"id":1e400}' END AS line,
          'response body' AS stage, count(*) AS n
        FROM rb WHERE b IN (5, 8, 9) GROUP BY 1""",
    "schema_merge_pair": """
        WITH side AS (
          SELECT c_custkey % 2 AS parity, c_nationkey, c_mktsegment AS key,
            ['{}', 'null', '{"type":"string"}', '{"type":"number"}', '{"type":"boolean"}'][min(c_custkey) % 5 + 1] AS schema
          FROM customer GROUP BY ALL),
        l AS (SELECT * FROM side WHERE parity = 0 AND schema <> 'null'),
        r AS (SELECT * FROM side WHERE parity = 1 AND schema <> '{}')
        SELECT c_nationkey, key, coalesce(r.schema, l.schema) AS schema
        FROM l FULL JOIN r USING (c_nationkey, key)""",
    "find_rows": _with(_ORDERS) + """
        SELECT * FROM o WHERE deleted_at IS NULL AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""",
    "page_live_rows": _with(_ORDERS) + """
        SELECT * FROM o WHERE deleted_at IS NULL AND o_orderstatus = 'O'
        ORDER BY o_totalprice DESC, id LIMIT 50 OFFSET 25""",
    "api_page": _with(_E) + f"""
        SELECT api_id AS id, path, method, {_NOW} + length(path) * 86400000000 AS created_at
        FROM (SELECT DISTINCT api_id, path, method FROM a) ORDER BY created_at DESC, id LIMIT 7 OFFSET 3""",
    "first_match": _with(_ORDERS) + """
        SELECT * FROM o WHERE deleted_at IS NULL AND o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
        QUALIFY row_number() OVER (ORDER BY created_at, id) = 1""",
    "count_rows": _with(_E) + """
        SELECT 'apis' AS what, count(DISTINCT path) AS n FROM a
        UNION ALL SELECT 'open orders', count(*) FROM orders WHERE o_orderstatus = 'O'""",
    "valid_inputs": """
        SELECT page_id, url AS endpoint, CASE page_id % 4 WHEN 0 THEN 'request' ELSE 'response' END AS type
        FROM pages WHERE page_id % 5 <> 0 AND page_id % 4 < 2""",
    "insert_stamped": f"""
        SELECT lpad(CAST(p_partkey AS VARCHAR), 24, '0') AS id,
          CASE WHEN p_partkey % 3 = 0 THEN epoch_us(TIMESTAMP '2024-01-15') ELSE {_STAMP} END AS created_at,
          CASE WHEN p_partkey % 3 <> 0 THEN {_STAMP} END AS updated_at,
          CAST(NULL AS BIGINT) AS deleted_at, p_name AS name,
          '{{"p_brand":"' || p_brand || '","p_size":' || p_size || '}}' AS properties
        FROM part""",
    "update_many": _with(_ORDERS) + f"""
        SELECT id, created_at, CASE WHEN hit THEN {_STAMP} ELSE updated_at END AS updated_at, deleted_at,
          o_custkey, CASE WHEN hit THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
          CASE WHEN hit THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority
        FROM (SELECT *, o_orderpriority = '1-URGENT' AS hit FROM o)""",
    "update_first": _with(_ORDERS) + f"""
        SELECT id, created_at, CASE WHEN hit THEN {_STAMP} ELSE updated_at END AS updated_at, deleted_at,
          o_custkey, CASE WHEN NOT hit THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority
        FROM (SELECT *, o_orderpriority = '2-HIGH' AND row_number() OVER (
                PARTITION BY o_orderpriority ORDER BY created_at, id) = 1 AS hit FROM o)""",
    "modified_counts": """
        SELECT 'many' AS what, count(*) AS modified FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'one', least(count(*), 1) FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'none', 0""",
    "soft_delete": _with(_SUPPLIERS) + f"""
        SELECT id, created_at, CASE WHEN s_nationkey % 2 = 0 THEN {_STAMP} ELSE created_at END AS updated_at,
          CASE WHEN s_nationkey % 2 = 0 THEN {_STAMP} END AS deleted_at, s_nationkey, s_name, s_acctbal FROM s""",
    "delete_rows": _with(_SUPPLIERS) + """
        SELECT id, created_at, created_at AS updated_at, CAST(NULL AS BIGINT) AS deleted_at, s_nationkey, s_name, s_acctbal
        FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey > 10 ORDER BY created_at, id) AS n FROM s)
        WHERE NOT (s_nationkey > 10 AND n = 1) AND id <> '000000000000000000000007'""",
    "structure_upsert": _with(_CUSTOMERS) + f""",
        i AS (SELECT c_nationkey, c_mktsegment, arg_max(c_name, c_custkey) AS c_name,
                arg_max(bal, c_custkey)[1] AS c_acctbal FROM (
                SELECT c_nationkey, c_mktsegment, upper(c_name) AS c_name,
                  [CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END] AS bal, c_custkey
                FROM customer WHERE c_nationkey % 2 = 0
                UNION ALL SELECT c_nationkey + 100, c_mktsegment, c_name, [c_acctbal], c_custkey
                FROM customer WHERE c_nationkey % 5 = 1) GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY created_at, id) = 1 AS top FROM c),
        j AS (SELECT f.*, i.c_name AS new_name, i.c_acctbal AS new_bal, i.c_nationkey IS NOT NULL AND top AS hit
              FROM f LEFT JOIN i USING (c_nationkey, c_mktsegment))
        SELECT id, created_at, CASE WHEN hit THEN {_STAMP} ELSE created_at END AS updated_at,
          CAST(NULL AS BIGINT) AS deleted_at, c_nationkey, c_mktsegment,
          CASE WHEN hit THEN new_name ELSE c_name END AS c_name, CASE WHEN hit THEN new_bal ELSE c_acctbal END AS c_acctbal
        FROM j
        UNION ALL
        SELECT substr(sha256(c_nationkey || '/' || c_mktsegment), 1, 24), {_STAMP}, {_STAMP}, NULL,
          c_nationkey, c_mktsegment, c_name, c_acctbal
        FROM i ANTI JOIN c USING (c_nationkey, c_mktsegment)""",
    "upsert_by_id": _with(_CUSTOMERS) + f""",
        i AS (SELECT lpad(CAST(c_custkey * 2 AS VARCHAR), 24, '0') AS id, c_nationkey, c_mktsegment FROM customer)
        SELECT coalesce(c.id, i.id) AS id, coalesce(c.created_at, {_STAMP}) AS created_at,
          CASE WHEN i.id IS NULL THEN c.created_at ELSE {_STAMP} END AS updated_at, CAST(NULL AS BIGINT) AS deleted_at,
          coalesce(i.c_nationkey, c.c_nationkey) AS c_nationkey, coalesce(i.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
          CASE WHEN i.id IS NULL THEN c.c_name ELSE 'new' END AS c_name,
          CASE WHEN i.id IS NULL THEN c.c_acctbal END AS c_acctbal
        FROM c FULL JOIN i ON c.id = i.id""",
    "upsert_counts": """
        SELECT count(c.c_custkey) AS matched, count(*) - count(c.c_custkey) AS inserted
        FROM (SELECT c_custkey * 2 AS k FROM customer) i LEFT JOIN customer c ON c.c_custkey = i.k""",
    "newest_per_api": _with(_E) + "SELECT api_id, max(us) AS newest FROM a GROUP BY 1",
    "time_range": _with(_E) + """
        SELECT sid AS id, us AS created_at FROM a
        WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-15')""",
    "stale_apis": _with(_E, _CURSORS) + """
        SELECT 'fixed' AS gate, api_id, cursor FROM g WHERE cursor IS NULL OR newest >= cursor
        UNION ALL SELECT 'legacy', api_id, cursor FROM g WHERE cursor IS NULL OR cursor >= newest""",
    "window_samples": _with(_E, _CURSORS) + """
        SELECT api_id, count(*) AS n, min(us) AS first FROM a JOIN g USING (api_id, path)
        WHERE cursor IS NULL OR us >= cursor GROUP BY 1""",
    "cursor_moves": _with(_E, _CURSORS) + f"""
        SELECT api_id AS id, CASE WHEN due THEN {_STAMP} ELSE cursor END AS latest_build_structure,
          CASE WHEN due THEN {_STAMP} ELSE {_NOW} END AS updated_at, {_NOW} AS created_at
        FROM (SELECT *, cursor IS NULL OR newest >= cursor AS due FROM g)""",
    "openapi_docs": _documents("ord"),
    "build_all": _documents("ord"),
    "incremental_build": _documents("CAST(2 - event_id % 3 AS VARCHAR) || ord"),
}

_MOST = """CASE h WHEN 30 THEN 0 WHEN 31 THEN 201 WHEN 32 THEN 202 WHEN 33 THEN 0
  ELSE CASE WHEN event_type = 'error' THEN 500 ELSE 200 END END"""
_VALUE = "CAST(value AS VARCHAR)"
_TAGS = """['[]', '["a"]', '[1]', '[{"x":1},{"y":"s"}]', '[null]', '[[1]]'][event_id % 6 + 1]"""
_DEEP_BODY = '{"deep":{"a":{"b":{"c":{"d":{"e":{"f":{"g":[{"h":true}]}}}}}}}}'
# The response body of an event, as text.
_BODY = f"""CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE CASE event_id % 23
    WHEN 5 THEN '{{"id":1}} x' WHEN 6 THEN '[1,2]' WHEN 7 THEN 'null' WHEN 8 THEN '3' WHEN 9 THEN '{{"id":1e400}}'
    WHEN 10 THEN '{{"id":1,"id":"s"}}' WHEN 12 THEN '{_DEEP_BODY}'
    ELSE '{{"id":' || event_id || ',"value":' || CASE WHEN event_id % 5 = 0 THEN '"' || {_VALUE} || '"' ELSE {_VALUE} END
      || CASE WHEN event_type = 'error' THEN ',"error":"broken \\"pipe\\""' ELSE '' END
      || CASE WHEN event_id % 2 = 0 THEN ',"user":{{"id":1,"tier":"gold"}}' ELSE ',"user":{{"id":1,"flag":true}}' END
      || ',"tags":' || {_TAGS} || ',"note":null}}' || chr(10) END END"""
SQL["response_samples"] = _with(_E) + f"""
    SELECT sid AS id, api_id, {_MOST} AS http_status_code, us AS event_at, md5({_BODY}) AS body_md5
    FROM a WHERE event_id % 11 <> 0"""


def _quoted(text: str) -> str:
    """SQL for a text as a JSON string; null stays."""
    return f"""('"' || replace(replace(replace({text}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"')"""


# The record of an event, as the text that cleaning must find.
_URL = """'https://gw.example.com:443/v1/' || CASE WHEN w THEN 'private/' ELSE '' END || event_type || '/'
    || CASE WHEN event_id % 10 = 4 THEN substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-'
         || substr(d, 17, 4) || '-' || substr(d, 21, 12) ELSE CAST(user_id AS VARCHAR) END
    || CASE WHEN event_id % 3 = 0 THEN ':confirm' ELSE '' END || '?limit=20&page=' || event_id % 7"""
_QUERY = """'{"limit":"20","page":"' || event_id % 7 || '"' || CASE WHEN event_id % 4 = 0 THEN ',"q":"x y"' ELSE '' END
    || CASE event_id % 9 WHEN 0 THEN ',"1":"on"' WHEN 3 THEN ',"12":"z"' ELSE '' END || '}'"""
_RECORD_TEXT = f"""
q AS (SELECT e.*, md5(CAST(event_id AS VARCHAR)) AS d FROM e),
r AS (SELECT *,
    CASE WHEN h = 24 THEN '{{' ELSE '{{"method":' || CASE WHEN w THEN '"POST"' ELSE '"GET"' END || ',' END
    || '"url":' || CASE WHEN h = 23 THEN '5' ELSE '"' || {_URL} || '"' END
    || ',"body":' || CASE WHEN h = 25 THEN '5' WHEN w THEN coalesce({_quoted("props")}, 'null') ELSE '""' END
    || ',"querystring":' || CASE h WHEN 26 THEN '[1]' WHEN 27 THEN '{{"limit":20}}' ELSE {_QUERY} END
    || ',"headers":{{"accept":"*/*"}}}}' AS request,
    '{{"status":' || CASE h WHEN 30 THEN 'null' WHEN 31 THEN '"201"' WHEN 32 THEN '202.7' WHEN 33 THEN '"x"'
        ELSE CASE WHEN event_type = 'error' THEN '500' ELSE '200' END END
    || ',"body":' || CASE WHEN h = 28 THEN '5' ELSE coalesce({_quoted(_BODY)}, 'null') END || ',"size":10}}' AS response
  FROM q),
t AS (SELECT *, CASE h WHEN 17 THEN '{{not json}}' WHEN 29 THEN '[1]' ELSE
    '{{"client":"' || CASE WHEN h = 15 THEN 'ĐA😀' ELSE '10.0.0.1' END || '","started_at":' || epoch_us(ts) // 1000
    || CASE h WHEN 18 THEN '' WHEN 19 THEN ',"request":null' WHEN 20 THEN ',"request":"r"' ELSE ',"request":' || request END
    || CASE h WHEN 21 THEN '' WHEN 22 THEN ',"response":null' ELSE ',"response":' || response END || '}}' END AS cleaned
  FROM r)
"""
SQL["clean_lines"] = _with(_E, _RECORD_TEXT) + """
    SELECT clean AS reason, count(*) AS n,
      count(*) FILTER (WHERE clean = '' AND h <> 29) AS n_extractable,
      CAST(sum(CASE h WHEN 3 THEN epoch_us(TIMESTAMP '2024-01-01 00:00:00.123456')
                 WHEN 4 THEN epoch_us(TIMESTAMP '2024-01-01 00:00:00.5') ELSE 0 END) AS BIGINT) AS receive_micros,
      CAST(coalesce(sum(CASE WHEN clean = '' THEN CAST('0x' || substr(md5(cleaned), 1, 8) AS BIGINT) END), 0) AS BIGINT) AS text_digests
    FROM t GROUP BY 1"""
SQL["folder_scan"] = _with(_E) + """
    SELECT CASE WHEN clean <> '' THEN 'clean' WHEN record <> '' THEN 'record' ELSE '' END AS stage,
      CASE WHEN clean <> '' THEN clean ELSE record END AS reason, 2 * count(*) AS n, 2 * count(*) AS n_ids
    FROM e GROUP BY 1, 2"""
SQL["damaged_files"] = _with(_E) + """
    SELECT 'user-' || user_id % 50 || '-' || event_id % blocks AS file, count(*) AS n_lines,
      count(*) FILTER (WHERE clean = '' AND record = '') AS n_accepted, CASE WHEN user_id % 50 % 4 = 0 THEN 0 ELSE 1 END AS n_damaged
    FROM e, (SELECT count(*) // 5000 + 1 AS blocks FROM events) GROUP BY user_id % 50, event_id % blocks"""
for _name in ("late_files", "overlapping_ingest", "same_stamps"):
    SQL[_name] = _documents("CAST(1 - event_id % 2 AS VARCHAR) || ord")
SQL["incremental_oldest"] = _documents("ord")
SQL["refreshed_documents"] = f"SELECT *, CASE WHEN path LIKE '%/purchase/%' THEN 5 ELSE 3 END AS version FROM ({_documents('ord')})"
SQL["arrival_orders"] = f"SELECT * FROM ({_documents('ord')}), (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS arrival_order)"
SQL["far_page"] = _with(_ORDERS) + """
    SELECT * FROM o WHERE deleted_at IS NULL AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, id LIMIT 40 OFFSET 300"""
SQL["page_chain"] = _with(_ORDERS) + """
    SELECT *, CAST((row_number() OVER (ORDER BY o_orderpriority DESC, o_custkey, id) - 1) // (count(*) OVER () // 5 + 1) AS INTEGER) AS page
    FROM o WHERE deleted_at IS NULL AND o_orderstatus = 'O'"""
# Changes one after the other; the places of first matches are worked out on what the change before has left.
_CHANGED = _with(_ORDERS) + f""",
    one AS (SELECT id FROM o WHERE o_orderpriority = '2-HIGH' ORDER BY created_at, id LIMIT 1),
    removed AS (SELECT id FROM o WHERE o_orderpriority = '5-LOW' ORDER BY created_at, id LIMIT 1),
    c2 AS (SELECT id, created_at, deleted_at, o_custkey, o_orderpriority,
        CASE WHEN id IN (FROM one) THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        CASE WHEN o_custkey % 30 = 7 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
        id IN (FROM one) OR o_custkey % 30 = 7 OR o_custkey = 11 AS hit FROM o),
    c5 AS (SELECT * REPLACE (CASE WHEN o_custkey = 11 THEN {_STAMP} ELSE deleted_at END AS deleted_at) FROM c2 WHERE id NOT IN (FROM removed)),
    i AS (SELECT lpad(CAST(o_orderkey * 3 AS VARCHAR), 24, '0') AS id, o_custkey FROM orders WHERE o_orderkey % 40 = 0),
    c6 AS (SELECT coalesce(c5.id, i.id) AS id, coalesce(created_at, {_STAMP}) AS created_at, deleted_at,
        coalesce(i.o_custkey, c5.o_custkey) AS o_custkey, o_orderpriority,
        CASE WHEN i.id IS NULL THEN o_orderstatus ELSE 'N' END AS o_orderstatus, o_totalprice,
        coalesce(hit, false) OR i.id IS NOT NULL AS hit FROM c5 FULL JOIN i ON c5.id = i.id),
    k AS (SELECT DISTINCT o_custkey * 2 AS o_custkey, upper(o_orderpriority) AS o_orderpriority FROM orders WHERE o_custkey % 50 = 1),
    firsts AS (SELECT arg_min(id, (created_at, id)) AS id FROM c6 JOIN k USING (o_custkey, o_orderpriority) GROUP BY o_custkey, o_orderpriority),
    added AS (SELECT * FROM k ANTI JOIN c6 USING (o_custkey, o_orderpriority))
"""
SQL["bucket_rows"] = _CHANGED + f"""
    SELECT id, created_at, CASE WHEN hit OR id IN (FROM firsts) THEN {_STAMP} ELSE created_at END AS updated_at, deleted_at, o_custkey,
      o_orderstatus, CASE WHEN id IN (FROM firsts) THEN 0.5 ELSE o_totalprice END AS o_totalprice, o_orderpriority
    FROM c6 UNION ALL
    SELECT substr(sha256(o_custkey || '/' || o_orderpriority), 1, 24), {_STAMP}, {_STAMP}, NULL, o_custkey, NULL, 0.5, o_orderpriority FROM added"""
SQL["bucket_counts"] = _CHANGED + """
    SELECT 'one' AS what, (SELECT count(*) FROM one) AS modified, 0 AS inserted, 0 AS deleted, true AS one_bucket
    UNION ALL SELECT 'many', (SELECT count(*) FROM o WHERE o_custkey % 30 = 7), 0, 0, false
    UNION ALL SELECT 'soft', (SELECT count(*) FROM o WHERE o_custkey = 11), 0, 0,
      (SELECT count(*) = 1 FROM o WHERE o_custkey = 11)
    UNION ALL SELECT 'removed', 0, 0, (SELECT count(*) FROM removed), true
    UNION ALL SELECT 'by id', (SELECT count(*) FROM i SEMI JOIN c5 USING (id)), (SELECT count(*) FROM i ANTI JOIN c5 USING (id)), 0, false
    UNION ALL SELECT 'by key', (SELECT count(*) FROM firsts), (SELECT count(*) FROM added), 0, false
    UNION ALL SELECT 'none', 0, 0, 0, false"""
SQL["rebuild_after_delete"] = _with(_E, _RESPONSE_BODIES, _RESPONSE_VALUES) + """,
    s AS (SELECT api_id, count(*) FILTER (WHERE event_id % 2 = 0) AS n0, count(*) FILTER (WHERE event_id % 2 = 1) AS n1
          FROM a WHERE event_id % 11 <> 0 GROUP BY 1),
    k AS (SELECT api_id, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM rv WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT api_id, CAST(n1 > 0 AS BIGINT) AS n_live, CAST(n0 > 0 AS BIGINT) AS n_deleted,
      CAST(n0 > 0 AS BIGINT) + CAST(n1 > 0 AS BIGINT) AS n_ids, coalesce(keys, '') AS live_keys
    FROM s LEFT JOIN k USING (api_id)"""
SQL["schema_merge_deep"] = """
    WITH m AS (SELECT c_nationkey, c_mktsegment, max(c_custkey % 2) AS odd FROM customer GROUP BY ALL)
    SELECT c_nationkey, 'k' AS key, '{"properties":{' || string_agg('"' || c_mktsegment || '":{"type":"'
      || CASE WHEN odd = 1 THEN 'string' ELSE 'number' END || '"}', ',' ORDER BY c_mktsegment) || '},"type":"object"}' AS schema
    FROM m GROUP BY 1"""
