"""Joining many rows to one row per key when a key may hold a large share of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are joined without a shuffle. A key beyond them has less than this share of the rows.
HOT_KEYS = 1000


def attach_by_key(
    rows: DataFrame,
    per_key: DataFrame,
    keys: list[str],
    weight: str,
    hot_rows: int,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Inner join `rows` to the unique-keyed `per_key`, whose `weight` counts rows per key.

    The keys with more than `hot_rows` rows, the `hot_keys` largest at most, are sent to all
    tasks, and their rows stay where they are, equal rows too: no task gets more of a hot key than it read. All
    other rows are shuffled by key; a key among them has at most `hot_rows` rows or less than
    1 / `hot_keys` of all. Looks at `per_key`, which should be written: without hot keys this is a
    plain join and the rows are read once.
    """
    hot = per_key.where(F.col(weight) > hot_rows).orderBy(F.desc(weight), *keys).limit(hot_keys)
    if hot.isEmpty():
        return rows.join(per_key, keys)
    in_place = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return in_place.unionByName(rest.join(per_key, keys))
