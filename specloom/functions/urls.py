"""URL splitting and path templating."""

from pyspark.sql import Column, DataFrame, functions as F

# The usual form: scheme, host, maybe a port, a path and a query without escapes or oddities.
_USUAL = (
    r"^[A-Za-z][A-Za-z0-9+.-]*+://[A-Za-z0-9._-]*+(?::[0-9]*+)?"
    r"(?:/[^%?#\x00-\x1F\x7F]*+)?(?:\?[^#\x00-\x1F\x7F]*+)?\z"
)
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_CONTROL = r"[\x00-\x1F\x7F]"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_USERINFO = r"^[A-Za-z0-9._:~!$&'()*+,;=%@-]*+\z"
# Host characters; only non-ASCII bytes (and the percent sign) may come percent-encoded.
_HOST = (
    r"^(?:[A-Za-z0-9!$&'()*+,;=:\[\]<>\"_.~-]|[^\x00-\x7F]|%25|%[89A-Fa-f][0-9A-Fa-f])*+\z"
)
_PORT = r"^(?::[0-9]*)?\z"

_HEX4 = "[0-9A-Fa-f]{4}"
_UUID36 = rf"[0-9A-Fa-f]{{8}}-{_HEX4}-{_HEX4}-{_HEX4}-[0-9A-Fa-f]{{12}}"
# Hyphenated, bare, or hyphenated between any two one-byte characters (braces, usually).
UUID = rf"^(?:{_UUID36}|[0-9A-Fa-f]{{32}}|[\x00-\x7F]{_UUID36}[\x00-\x7F])\z"
INTEGER = r"^[+-]?[0-9]+\z"


def percent_decode(text: Column) -> Column:
    """Decode %XX; a plus sign stays one. Null on a bad escape."""
    plain = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.when(~text.contains("%"), text).when(
        ~text.rlike(_BAD_ESCAPE), F.try_url_decode(plain)
    )


def with_url_parts(df: DataFrame, url: str, host: str = "host", path: str = "path") -> DataFrame:
    """Add ``host`` (no port) and ``path`` (percent-decoded); both '' if the URL is unusable.

    A URL of the usual form is matched once and then cut at its first '://', '?', '/' and ':'; groups of the pattern
    would match it again for each part.
    """
    df = df.withColumn("_usual", url.rlike(_USUAL))
    usual = F.col("_usual")
    df = df.withColumn("_before", F.when(usual, F.substring_index(F.make_valid_utf8(url), "?", 1)))
    before, after, site = F.col("_before"), F.col("_after"), F.col("_site")
    df = df.withColumn("_after", F.substring(before, F.locate("://", before) + 3, F.length(before)))
    df = df.withColumn("_site", F.substring_index(after, "/", 1))
    df = df.withColumn("_u", F.when(~usual, F.substring_index(url, "#", 1)))
    df = df.withColumn("_schemed", F.col("_u").rlike(_SCHEME))
    df = df.withColumn("_rest", F.substring_index(F.regexp_replace("_u", _SCHEME, ""), "?", 1))
    rest, schemed = F.col("_rest"), F.col("_schemed")
    df = df.withColumn(
        "_has_authority", rest.startswith("//") & (schemed | ~rest.startswith("///"))
    )
    df = df.withColumn(
        "_authority", F.when(F.col("_has_authority"), F.regexp_extract("_rest", r"^//([^/]*)", 1))
    )
    authority = F.col("_authority")
    df = df.withColumn("_netloc", F.substring_index(authority, "@", -1)).withColumn(
        "_path",
        percent_decode(
            F.when(F.col("_has_authority"), F.regexp_replace("_rest", r"^//[^/]*", "")).otherwise(rest)
        ),
    )
    netloc = F.col("_netloc")
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    bracketed = netloc.startswith("[")
    port = (
        F.when(bracketed, F.regexp_extract(netloc, r"^.*\](.*)\z", 1))
        .when(netloc.contains(":"), F.concat(F.lit(":"), F.substring_index(netloc, ":", -1)))
        .otherwise(F.lit(""))
    )
    bad_authority = (
        ~user.rlike(_USERINFO)
        | user.rlike(_BAD_ESCAPE)
        | ~netloc.rlike(_HOST)
        | ~port.rlike(_PORT)
        | (bracketed & ~netloc.contains("]"))
    )
    unrooted = ~rest.startswith("/")
    unusable = (
        F.col("_u").rlike(_CONTROL)
        | F.col("_u").startswith(":")
        | F.col("_path").isNull()
        | F.substring(url, F.length("_u") + 1, F.length(url)).rlike(_BAD_ESCAPE)
        | (unrooted & (schemed | F.substring_index(rest, "/", 1).contains(":")))
        | F.coalesce(bad_authority, F.lit(False))
    )
    bare_host = F.coalesce(percent_decode(F.substring_index(netloc, ":", 1)), F.lit(""))
    return (
        df.withColumn("_unusable", unusable & (F.col("_u") != "*"))
        .withColumns(
            {
                host: F.when(usual, F.substring_index(site, ":", 1))
                .when(F.col("_unusable"), F.lit(""))
                .otherwise(bare_host),
                path: F.when(usual, F.substring(after, F.length(site) + 1, F.length(after)))
                .when(F.col("_unusable"), F.lit(""))
                .otherwise(F.col("_path")),
            }
        )
        .drop("_usual", "_before", "_after", "_site", "_u", "_schemed", "_rest", "_has_authority", "_authority", "_netloc", "_path", "_unusable")
    )


def is_uuid(part: Column) -> Column:
    return part.rlike(UUID)


def is_integer(part: Column) -> Column:
    """A signed 64-bit decimal, without blanks."""
    return part.rlike(INTEGER) & part.try_cast("bigint").isNotNull()


def _template_part(part: Column) -> Column:
    return (
        F.when(is_uuid(part), F.lit("{uuid}"))
        .when(is_integer(part), F.lit("{id}"))
        .otherwise(part)
    )


def path_template(path: Column) -> Column:
    """Replace the UUID and integer parts of a path; parts end at '/' and ':'."""
    return F.array_join(
        F.transform(
            F.split(path, "/"),
            lambda seg: F.array_join(F.transform(F.split(seg, ":"), _template_part), ":"),
        ),
        "/",
    )


def api_id(template: Column) -> Column:
    """An API's id follows from its path template, so no lookup is needed to assign it."""
    return F.substring(F.sha2(template, 256), 1, 24)
