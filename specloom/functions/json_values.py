"""Strict JSON parsing to VARIANT, and what one JSON value says about its schema.

Children of a parsed value are carried as canonical JSON text (no blanks), whose first two
characters tell a value's kind; nothing has to walk the value to classify it.
"""

from pyspark.sql import Column, DataFrame, functions as F

_STRING = r'(?s)"(?:[^"\\]++|\\.)*+"'
_NUMBER = r"[0-9][0-9.eE+-]*+"
# Only a number with an exponent, or one of very many digits, can be beyond a double. Most characters fail the first class.
_MAYBE_BIG = r"[0-9.](?:[eE]\+?[0-9]|[0-9]{308})"


def has_out_of_range_number(text: Column) -> Column:
    """True if a number of the text does not fit a double. Strings are ignored."""
    numbers = F.regexp_extract_all(F.regexp_replace(text, _STRING, ""), F.lit(_NUMBER), F.lit(0))
    biggest = F.array_max(numbers.try_cast("array<double>"))
    return F.when(
        text.rlike(_MAYBE_BIG),
        F.coalesce(biggest == float("inf"), F.lit(False)),
    ).otherwise(F.lit(False))


def with_whole_value(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out``: ``src`` as VARIANT if it is exactly one JSON value, else null.

    Spark's parser stops after the first value and ignores what follows. Here the text is
    parsed as the first element of an array whose second element is a mark made from the
    text; only if the mark comes back in second and last place was the text one value.
    """
    mark = F.xxhash64(F.col(src)).cast("string")
    df = df.withColumn(
        "_pair", F.try_parse_json(F.concat(F.lit("["), F.col(src), F.lit(',"'), mark, F.lit('"]')))
    )
    whole = (F.try_variant_get("_pair", "$[1]", "string") == mark) & F.try_variant_get(
        "_pair", "$[2]", "variant"
    ).isNull()
    return df.withColumn(
        out, F.when(whole, F.try_variant_get("_pair", "$[0]", "variant"))
    ).drop("_pair")


def with_strict_json(df: DataFrame, src: str, out: str) -> DataFrame:
    """As ``with_whole_value``, but a number no double can hold refuses the text."""
    df = with_whole_value(df, src, out)
    return df.withColumn(out, F.when(~has_out_of_range_number(F.col(src)), F.col(out)))


def as_object(value: Column) -> Column:
    """Members of a JSON object as a map; null for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def is_absent(value: Column) -> Column:
    """Missing, or JSON null."""
    return value.isNull() | F.is_variant_null(value)


def produces_schema(text: Column) -> Column:
    """False for the values that say nothing: null, an empty array, an array led by null."""
    return ~((text == "null") | (text == "[]") | text.startswith("[null"))


def _kind_of(first: Column) -> Column:
    return (
        F.when(first == "{", F.lit("object"))
        .when(first == "[", F.lit("array"))
        .when(first == '"', F.lit("string"))
        .when(first.isin("t", "f"), F.lit("boolean"))
        .when(first == "n", F.lit("null"))
        .otherwise(F.lit("number"))
    )


def json_type(text: Column) -> Column:
    """Type name of a value in canonical JSON text."""
    return _kind_of(F.substring(text, 1, 1))


def items_type(text: Column) -> Column:
    """Type name of an array's first element."""
    return _kind_of(F.substring(text, 2, 1))


def shape(text: Column) -> Column:
    """A short stand-in with the same schema, so that scalars do not travel in full."""
    second = F.substring(text, 2, 1)
    kind = json_type(text)
    return (
        F.when((kind == "object") | text.startswith("[{"), text)
        .when(kind == "string", F.lit('""'))
        .when(kind == "boolean", F.lit("true"))
        .when(kind == "number", F.lit("0"))
        .when(second == '"', F.lit('[""]'))
        .when(second.isin("t", "f"), F.lit("[true]"))
        .when(second == "[", F.lit("[[]]"))
        .otherwise(F.lit("[0]"))
    )


def producing_members(obj: Column) -> Column:
    """Map of member name to JSON text, without the members that say nothing."""
    texts = F.transform_values(obj, lambda _, v: F.to_json(v))
    return F.map_filter(texts, lambda _, t: produces_schema(t))


def quoted(text: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]\z", "")
