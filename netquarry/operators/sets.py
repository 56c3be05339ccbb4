"""Insert-if-absent and the other set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_known(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], distinct: bool = True
) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``. A key with a NULL part conflicts with
    nothing, not even itself. With ``distinct`` one row per key is kept; callers that care which
    one reduce ``new`` first."""
    # an anti join keeps NULL keys and needs no distinct right side
    fresh = new.join(existing.select(*keys), list(keys), "left_anti").select(*new.columns)
    if not distinct:
        return fresh
    if not any(new.schema[k].nullable for k in keys):
        return fresh.dropDuplicates(list(keys))
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return fresh.filter(~has_null).dropDuplicates(list(keys)).unionByName(fresh.filter(has_null))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def missing_from(expected: DataFrame, produced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that were not produced."""
    return (
        expected.select(*keys)
        .distinct()
        .join(produced.select(*keys).distinct(), list(keys), "left_anti")
    )
