"""Names for columns that are added to tables whose columns may have any name."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, or with as many underscores as it takes to be none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
