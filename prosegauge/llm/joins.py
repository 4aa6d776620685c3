"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegauge.runtime import cut

#: A key is hot with more than one in SHARE of all rows (and LEAST at least), so there
#: are fewer than SHARE hot keys whatever the data, and their rows may be broadcast.
SHARE, LEAST = 256, 64


def hot(count: Column | str, total: int) -> Column:
    """Whether a key of so many rows is hot among ``total`` rows."""
    return F.coalesce(F.col(count) if isinstance(count, str) else count, F.lit(0)) > max(LEAST, total // SHARE)


#: Keys of which so many at most are broadcast (16 bytes each), after counting them.
FEW_KEYS = 1_000_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], *, total: int, count: str = "count", how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with the one row that ``table`` has for a key.

    ``table`` says in ``count`` how many of the ``total`` rows have its key.  The
    fewer than ``SHARE`` hot keys are broadcast, so their rows stay where they are;
    all others meet by an exchange in which no key has more than its share.
    Keys that are null match nothing.
    """
    is_hot = hot(count, total)
    few = table.where(is_hot).drop(count)
    added = [c for c in few.columns if c not in keys]
    near = rows.join(F.broadcast(few.withColumn("_hot", F.lit(True))), keys, "left")
    far = near.where("_hot is null").drop("_hot", *added).join(table.where(~is_hot).drop(count), keys, how)
    order = [*rows.columns, *added]
    return near.where("_hot").select(*order).unionByName(far.select(*order))


def only(rows: DataFrame, keys: DataFrame, *on: str, keep: bool = True) -> DataFrame:
    """``rows`` whose ``on`` is one of ``keys`` (distinct values of those columns), or is
    none of them.  Keys are counted, and broadcast while they are few.  Null is no key."""
    keys = cut(keys.select(*on).dropna())
    return rows.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, list(on), "left_semi" if keep else "left_anti")
