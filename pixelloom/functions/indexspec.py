"""Index lists such as "all", "0,2,5" and "1-5": for the driver, and as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_indices(spec: str, last: int | None = None) -> list[int] | None:
    """Indices in the order named, each once; None means all.

    Blank parts are skipped, ``a-b`` includes both ends and is empty if a > b. Anything that is no
    number raises ValueError, as does an index outside 0..``last`` where that is given.
    """
    if spec == "all":
        return None
    chosen: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        chosen.update(dict.fromkeys(range(int(low), int(high if dash else low) + 1)))
    if last is not None and (outside := [i for i in chosen if not 0 <= i <= last]):
        raise ValueError(f"Invalid index {outside[0]}. Valid range: 0..{last}")
    return list(chosen)


def parse_channels(spec: str) -> list[int]:
    """Sorted indices; "all" gives none, which callers take as no valid selection."""
    return sorted(parse_indices(spec) or [])


def indices_column(spec: Column) -> Column:
    """The same as an expression: array<int> in order, null for "all"."""

    def expand(part: Column) -> Column:
        low = F.trim(F.split(part, "-", 2)[0]).try_cast("int")
        high = F.trim(F.coalesce(F.get(F.split(part, "-", 2), F.lit(1)), part)).try_cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(spec != "all", F.array_distinct(F.flatten(F.transform(parts, expand))))
