"""Reading rows of a collection: filters, pages, first match, counts."""

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from specloom.operators.gate import live
from specloom.session import stage

# Columns of every collection; they are never assigned by an item.
BASE_COLUMNS = ("id", "created_at", "updated_at", "deleted_at")
# Rows up to the end of a page that a top-k may hold in each task; a page beyond is found by places.
FAR_ROWS = 100_000
# What an input may describe.
INPUT_TYPES = ("request", "response")


def _is_zero(value) -> bool:
    return value is None or (not isinstance(value, Column) and value in ("", 0, False))


def item_fields(item: Mapping, omit_empty: Iterable[str] = (), ignore_empty: bool = False) -> dict:
    """Fields an item stands for: base columns never, empty ones marked so only if kept."""
    skip = set(omit_empty) if ignore_empty else set()
    return {
        name: value
        for name, value in item.items()
        if name not in BASE_COLUMNS and not (name in skip and _is_zero(value))
    }


def matches(fields: Mapping) -> Column:
    """Conjunction of equalities, pushed down to the scan. A null matches null."""
    terms = [
        F.col(name).isNull() if value is None else F.col(name) == value
        for name, value in fields.items()
    ]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def find(df: DataFrame, cond: Column) -> DataFrame:
    """Live rows that match."""
    return live(df).where(cond)


def find_page(
    df: DataFrame,
    cond: Column,
    order: Iterable[Column] = (),
    limit: int = 0,
    offset: int = 0,
    far_rows: int = FAR_ROWS,
) -> DataFrame:
    """A page of the live rows that match; a limit of 0 means all. The id breaks ties.

    No task holds more than ``far_rows`` rows for it. To go through many pages, see :func:`page_after`.
    """
    order = [*order, F.col("id")]
    page = find(df, cond).orderBy(*order)
    if offset > 0 and (limit <= 0 or offset + limit > far_rows):
        return _from_place(page, offset, limit).orderBy(*order)
    page = page.offset(offset) if offset > 0 else page
    return page.limit(limit) if limit > 0 else page


def after(order: Iterable[tuple[str, bool]], last: Mapping) -> Column:
    """Rows that come behind a row with the values ``last``, sorted by ``order``: (column, whether descending).

    Comparisons of columns with values, which the scan prunes by. Nulls come first in ascending order, last in descending.
    """
    behind, same = [], F.lit(True)
    for name, descending in order:
        column, value = F.col(name), last[name]
        if value is None:
            beyond = F.lit(False) if descending else column.isNotNull()
            equal = column.isNull()
        else:
            beyond = (column < F.lit(value)) | column.isNull() if descending else column > F.lit(value)
            equal = column == F.lit(value)
        behind.append(same & beyond)
        same = same & equal
    return reduce(lambda a, b: a | b, behind)


def page_after(
    df: DataFrame, cond: Column, order: Iterable[tuple[str, bool]], limit: int, last: Mapping | None = None
) -> DataFrame:
    """The page that follows the row ``last`` (values of the sort columns and id), or the first one.

    However far the page, only its own rows are held, and rows before it are left out at the scan. Rows added or removed
    meanwhile shift no page, as they would with offsets. ``order`` has (column, whether descending); the id breaks ties.
    """
    order = [*order, ("id", False)]
    rest = cond if last is None else cond & after(order, last)
    return find(df, rest).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c, descending in order]).limit(limit)


def _from_place(page: DataFrame, offset: int, limit: int = 0) -> DataFrame:
    """Sorted rows from a place on, without a task that sees them all: places follow from the partitions' sizes."""
    columns = page.columns
    numbered = stage(page.withColumn("_row", F.monotonically_increasing_id()), "page")
    # The upper bits of that number are the partition, the lower 33 the place in it.
    part = F.shiftright("_row", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    bases = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_base"))
    placed = numbered.withColumn("_part", part).join(bases, "_part")
    place = F.col("_base") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    within = place >= offset if limit <= 0 else (place >= offset) & (place < offset + limit)
    return placed.where(within).select(*columns)


def api_page(apis: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the catalog, newest first."""
    return find_page(apis, F.lit(True), [F.col("created_at").desc()], limit, offset)


def first_match(df: DataFrame, cond: Column) -> DataFrame:
    """The first live row that matches, or none."""
    return find(df, cond).orderBy("created_at", "id").limit(1)


def by_id(df: DataFrame, row_id: str) -> DataFrame:
    return first_match(df, F.col("id") == row_id)


def count_rows(df: DataFrame, cond: Column | None = None) -> DataFrame:
    """Number of rows that match, soft-deleted ones included."""
    hit = df if cond is None else df.where(cond)
    return hit.agg(F.count("*").alias("n"))


def valid_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs with an endpoint and a known type."""
    return inputs.where((F.col("endpoint") != "") & F.col("type").isin(*INPUT_TYPES))
