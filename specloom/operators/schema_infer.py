"""Nested schema of JSON values, written out level by level with native expressions.

Each row holds one value as a list of segments: finished schema text, and pending values
at their place in it. One expansion replaces every pending value by the text of its node
and, inside it, its members as new pending values. All expansions are narrow projections;
they run on fold winners only, so their input does not grow with the number of samples.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from specloom.session import stage

LEVELS_PER_ROUND = 5


def _segment(text: str = "null", pending: str = "null", path: str = "null") -> str:
    return (
        f"named_struct('text', cast({text} AS string), 'pending', cast({pending} AS string), "
        f"'path', cast({path} AS array<string>))"
    )


def _literal(text: str) -> str:
    return f"'{text}'"


# Telling members of every object of a list, by name; of equal names the last object's wins, as the session's map
# policy says. One pass over all members, however many objects and names there are.
_MEMBERS = """
map_from_entries(flatten(transform({objects}, o -> coalesce(
  filter(
    map_entries(transform_values(try_variant_get(o, '$', 'map<string,variant>'), (k, v) -> to_json(v))),
    e -> NOT (e.value = 'null' OR e.value = '[]' OR startswith(e.value, '[null'))),
  cast(array() AS array<struct<key:string,value:string>>)))))
"""

# Members sorted by name, each as the text '"name":' and a pending value.
_CHILDREN = f"""
flatten(transform(array_sort(map_entries({{members}})), (e, i) -> array(
  {_segment(text="concat(if(i > 0, ',', ''), regexp_replace(to_json(array(e.key)), r'^\\[|\\]$', ''), ':')")},
  {_segment(pending="e.value", path="concat(s.path, array(e.key))")})))
"""

_TYPE = """
CASE substring({text}, {at}, 1)
  WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '"' THEN 'string'
  WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' ELSE 'number' END
"""


def _container(opening: str, objects: str, closing: str) -> str:
    children = _CHILDREN.format(members=_MEMBERS.format(objects=objects))
    head = _segment(text=_literal(opening), path="s.path")
    return f"concat(array({head}), {children}, array({_segment(text=_literal(closing))}))"


def _leaf(opening: str, type_: str, closing: str) -> str:
    text = f"concat({_literal(opening)}, {type_}, {_literal(closing)})"
    return f"array({_segment(text=text, path='s.path')})"


_OBJECT, _OBJECT_END = '{"properties":{', '},"type":"object"}'
_ARRAY, _ARRAY_END = '{"items":', ',"type":"array"}'
_SCALAR, _SCALAR_END = '{"type":"', '"}'

_EXPAND = f"""
flatten(transform(_segments, s -> CASE
  WHEN s.pending IS NULL THEN array(s)
  WHEN startswith(s.pending, '{{') THEN
    {_container(_OBJECT, "array(parse_json(s.pending))", _OBJECT_END)}
  WHEN startswith(s.pending, '[{{') THEN
    {_container(_ARRAY + _OBJECT, "try_variant_get(parse_json(s.pending), '$', 'array<variant>')", _OBJECT_END + _ARRAY_END)}
  WHEN startswith(s.pending, '[') THEN
    {_leaf(_ARRAY + _SCALAR, _TYPE.format(text="s.pending", at=2), _SCALAR_END + _ARRAY_END)}
  ELSE {_leaf(_SCALAR, _TYPE.format(text="s.pending", at=1), _SCALAR_END)}
END))
"""


def _expand_round(df: DataFrame) -> DataFrame:
    for _ in range(LEVELS_PER_ROUND):
        df = df.withColumn("_segments", F.expr(_EXPAND))
    return df.withColumn("_open", F.expr("exists(_segments, s -> s.pending IS NOT NULL)"))


def _fields() -> Column:
    """The nodes among the segments; a node's text tells its type."""
    return F.expr(f"""
        transform(filter(_segments, s -> s.path IS NOT NULL), s -> named_struct(
          'path', s.path,
          'type', CASE WHEN startswith(s.text, '{_ARRAY}') THEN 'array'
                       WHEN startswith(s.text, '{_OBJECT}') THEN 'object'
                       ELSE substring_index(substring(s.text, {len(_SCALAR) + 1}), '"', 1) END,
          'items_type', CASE WHEN startswith(s.text, '{_ARRAY}{_OBJECT}') THEN 'object'
                             WHEN startswith(s.text, '{_ARRAY}') THEN
                               substring_index(substring(s.text, {len(_ARRAY + _SCALAR) + 1}), '"', 1) END))
    """)


def infer_schemas(values: DataFrame, value: str = "value", root: str = "key") -> DataFrame:
    """Replace column ``value`` (JSON text that says something) by ``schema`` and ``fields``.

    ``schema`` is the node's JSON text with sorted keys; ``fields`` lists every node under
    it as (path, type, items_type), the path starting with column ``root``. Any depth is
    handled: rows still open after a round go into another one.
    """
    kept = [c for c in values.columns if c != value]
    start = F.expr(f"array({_segment(pending=value, path=f'array({root})')})")
    todo = values.select(*kept, start.alias("_segments"))
    done = []
    while True:
        todo = stage(_expand_round(todo), "schemas")
        done.append(todo.where("NOT _open"))
        todo = todo.where("_open").drop("_open")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, [d.drop("_open") for d in done]).select(
        *kept,
        F.expr("array_join(transform(_segments, s -> s.text), '')").alias("schema"),
        _fields().alias("fields"),
    )
