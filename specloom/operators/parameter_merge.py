"""Union of query parameters over stored structures and samples."""

from pyspark.sql import Column, DataFrame, functions as F

from specloom.functions.parameters import ANY_TYPE

_FIELDS = ("name", "type", "in", "required")


def _distinct(df: DataFrame, rank: int) -> DataFrame:
    """Distinct parameter rows per API: a hash aggregate over keys, combined before the shuffle."""
    rows = df.select("api_id", F.explode("parameters").alias("p"))
    return (
        rows.select("api_id", *[F.col(f"p.`{f}`").alias(f) for f in _FIELDS])
        .distinct()
        .withColumn("rank", F.lit(rank))
    )


def merge_parameters(stored: DataFrame, samples: DataFrame, stored_first: bool = True) -> DataFrame:
    """(api_id, parameters) with one parameter per name, sorted by name.

    The type stays if all agree, else it becomes 'any', also for good once stored. Location
    and requiredness come from the stored parameter if there is one; without ``stored_first``
    they are the least of all, so that the order of builds does not matter. Values are dropped.
    """
    merged = (
        _distinct(stored, 0 if stored_first else 1)
        .unionByName(_distinct(samples, 1))
        .groupBy("api_id", "name")
        .agg(
            F.min("type").alias("low"),
            F.max("type").alias("high"),
            F.min(F.struct("rank", "in", "required")).alias("first"),
        )
        .select(
            "api_id",
            F.struct(
                "name",
                F.when(F.col("low") == F.col("high"), F.col("low"))
                .otherwise(F.lit(ANY_TYPE))
                .alias("type"),
                F.lit("").alias("value"),
                F.col("first.in").alias("in"),
                F.col("first.required").alias("required"),
            ).alias("p"),
        )
    )
    return merged.groupBy("api_id").agg(F.array_sort(F.collect_list("p")).alias("parameters"))


def document_parameters(parameters: Column) -> Column:
    """Parameters as JSON for a document; null for a null list, '[]' for an empty one."""
    return F.to_json(
        F.transform(
            parameters,
            lambda p: F.struct(
                p["in"].alias("in"),
                p["name"].alias("name"),
                p["required"].alias("required"),
                F.struct(p["type"].alias("type")).alias("schema"),
            ),
        )
    )
