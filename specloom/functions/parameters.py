"""Query parameters: type from the name, rows from a query map, document fragments."""

from pyspark.sql import Column, functions as F

from specloom.functions.urls import is_integer

# Names that always mean an integer, and the spellings of a boolean.
INTEGER_NAMES = ("limit", "offset", "skip", "page", "size")
BOOLEAN_LITERALS = ("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False")
IN_QUERY = "query"
ANY_TYPE = "any"


def parameter_type(name: Column) -> Column:
    """The type a parameter's name suggests."""
    return (
        F.when(name.isin(*INTEGER_NAMES), F.lit("integer"))
        .when(name.isin(*BOOLEAN_LITERALS), F.lit("boolean"))
        .when(is_integer(name), F.lit("integer"))
        .otherwise(F.lit("string"))
    )


def parameter_rows(query: Column) -> Column:
    """Query map (name to text) as parameter structs, sorted by name."""
    return F.transform(
        F.sort_array(F.map_entries(query)),
        lambda e: F.struct(
            e["key"].alias("name"),
            parameter_type(e["key"]).alias("type"),
            e["value"].alias("value"),
            F.lit(IN_QUERY).alias("in"),
            F.lit(False).alias("required"),
        ),
    )
