"""Cleaning of archived log lines: UTF-8 repair, noise, unescaping, JSON extraction."""

from pyspark.sql import Column, DataFrame, functions as F

from specloom.functions.json_values import with_whole_value

# A line holding one of these markers is gateway noise.
NOISE_MARKERS = (
    ("Content-Type: image", "image content"),
    (".lua", "gateway debug"),
    ("config?check_hash", "gateway config"),
)

# The prefix a container runtime puts before a message, and the message.
CONTAINER_PREFIX = (
    r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z) (stderr|stdout) F[\t\n\f\r ]+"
)
JSON_OBJECT = r"(?d)^\{.*\}"

# The body of a quoted string: no bare quote, and only these escapes. Code points of the
# surrogate range are not escapable. Possessive loops keep the matcher off the stack.
_ESCAPE = (
    r"(?:[abfnrtv\\\"]"
    r"|x[0-9A-Fa-f]{2}"
    r"|u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"
    r"|U(?:0000(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|000[1-9A-Fa-f][0-9A-Fa-f]{4}|0010[0-9A-Fa-f]{4})"
    r"|[0-3][0-7]{2})"
)
QUOTABLE = rf'^[^"\\\n]*+(?:\\{_ESCAPE}[^"\\\n]*+)*+\z'

_TOKENS = r"(?s)[^\\]++|\\(?:x..|u....|U........|[0-7]{3}|.)"
_CONTROL_ESCAPES = {
    "a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D",
    '"': "22", "\\": "5C",
}


def noise_reason(line: Column) -> Column:
    """Why a line is noise, or null."""
    reason = F.lit(None).cast("string")
    for marker, name in reversed(NOISE_MARKERS):
        reason = F.when(line.contains(marker), F.lit(name)).otherwise(reason)
    return reason


def _token_hex(token: Column) -> Column:
    kind = F.substring(token, 2, 1)
    out = F.when(~token.startswith("\\"), F.hex(token))
    for letter, code in _CONTROL_ESCAPES.items():
        out = out.when(kind == letter, F.lit(code))
    return (
        out.when(kind == "x", F.upper(F.substring(token, 3, 2)))
        .when(kind == "u", F.hex(F.decode(F.unhex(F.substring(token, 3, 4)), "UTF-16BE")))
        .when(kind == "U", F.hex(F.decode(F.unhex(F.substring(token, 3, 8)), "UTF-32")))
        .otherwise(F.lpad(F.conv(F.substring(token, 2, 3), 8, 16), 2, "0"))
    )


def _decode_bytes(line: Column) -> Column:
    """Decode every escape of a quotable line, byte by byte."""
    tokens = F.regexp_extract_all(line, F.lit(_TOKENS), F.lit(0))
    as_bytes = F.unhex(F.array_join(F.transform(tokens, _token_hex), ""))
    return F.make_valid_utf8(as_bytes.cast("string"))


def with_unescaped(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out``: the text ``src`` stands for as the body of a quoted string, or null.

    The JSON parser decodes nearly all lines. It takes two kinds of escape a quoted string
    may not have, a slash and surrogates, so lines that may hold those are checked against
    the grammar. Lines it refuses are decoded byte by byte if the grammar allows them.
    """
    line = F.col(src)
    df = df.withColumn("_quoted", F.concat(F.lit('"'), line, F.lit('"')))
    df = with_whole_value(df, "_quoted", "_parsed")
    df = df.withColumn("_decoded", F.try_variant_get("_parsed", "$", "string"))
    decoded = F.col("_decoded")
    unsure = line.contains("\\/") | line.contains("\\u") | decoded.isNull()
    return df.withColumn(
        out,
        F.when(~unsure, decoded)
        .when(~line.rlike(QUOTABLE), F.lit(None).cast("string"))
        .when(decoded.isNotNull(), decoded)
        .otherwise(_decode_bytes(line)),
    ).drop("_quoted", "_parsed", "_decoded")


def with_clean_text(
    df: DataFrame, src: str = "value", max_line_bytes: int | None = None
) -> DataFrame:
    """Add ``text``, ``clean_reason``, ``receive_time`` and ``extractable``.

    ``text`` is null exactly where ``clean_reason`` says why the line was refused. With
    ``max_line_bytes`` a line and its newline must fit in that; by default any length will do.
    """
    fits = F.lit(True) if max_line_bytes is None else F.octet_length(F.col(src)) < max_line_bytes
    df = df.withColumn("_valid", F.when(fits, F.make_valid_utf8(F.col(src))))
    valid = F.col("_valid")
    df = df.withColumn(
        "_utf8",
        F.when(valid.endswith("\r"), F.regexp_replace("_valid", r"\r\z", "")).otherwise(valid),
    )
    df = df.withColumn("_noise", noise_reason(F.col("_utf8")))
    df = df.withColumn("_line", F.when(F.col("_noise").isNull(), F.col("_utf8")))
    df = with_unescaped(df, "_line", "_plain")
    plain, message = F.col("_plain"), F.col("_message")
    prefixed = F.substring(plain, 1, 1).between("0", "9")
    df = df.withColumn(
        "_message", F.when(prefixed, F.regexp_replace("_plain", CONTAINER_PREFIX, "")).otherwise(plain)
    )
    df = df.withColumn(
        "_json",
        F.when(
            message.startswith("{") & message.endswith("}") & ~message.contains("\n"), message
        ).otherwise(F.regexp_extract("_message", JSON_OBJECT, 0)),
    )
    stamp = F.when(prefixed, F.nullif(F.regexp_extract("_plain", CONTAINER_PREFIX, 1), F.lit("")))
    return df.select(
        "*",
        F.when(F.col("_json") != "", F.col("_json")).otherwise(message).alias("text"),
        F.when(F.col(src).isNull(), F.lit("no line"))
        .when(F.col("_utf8").isNull(), F.lit("line too long"))
        .when(F.col("_noise").isNotNull(), F.col("_noise"))
        .when(plain.isNull(), F.lit("bad escape"))
        .alias("clean_reason"),
        F.try_to_timestamp(stamp).alias("receive_time"),
        (F.col("_json") != "").alias("extractable"),
    ).drop("_valid", "_utf8", "_noise", "_line", "_plain", "_message", "_json")
