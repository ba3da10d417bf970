"""Exact medians of large groups without bringing a group into one task.

The median is narrowed down in grouped counts: logarithmic cells of all values, then
linear cells of the one cell that holds the median, again and again until a cell has a
single value. Each pass counts map-side, so a value or a cell that many rows share
shrinks to one row per task before it is shuffled, and what is put in order is at most
4097 linear cells (or the logarithmic cells of a double's range) per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 32 cells per power of two over the range of a double, on both sides of zero
# (infinities have cells of their own), then 4096 linear cells inside one of them.
_LOG_CELL = """CASE WHEN value = 0 THEN 0D
    ELSE signum(value) * (floor(least(log2(abs(value)) * 32, 35000D)) + 40000) END"""
_LINEAR_CELL = "CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 4096) ELSE 0 END"


def exact_medians(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per key with the median of each measure, NULLs left out.

    `rows` is read once per pass, so it should be a table or cached. The keys must have
    few distinct values (factor levels, years of the window): one row per key and measure
    comes to the driver after each pass. A linear pass divides a bracket by 4096, so two
    are usual and five reach neighbouring doubles.
    """
    values = rows.unpivot(keys, measures, "measure", "value").where("value IS NOT NULL")
    group = [*keys, "measure"]
    found = _narrow(
        values.selectExpr(
            "*", "0L AS below", "cast(NULL AS bigint) AS total",
            "cast(NULL AS double) AS lower", "cast(NULL AS double) AS upper",
        ),
        group,
        _LOG_CELL,
    )
    while True:
        brackets = found.collect()
        found = rows.sparkSession.createDataFrame(brackets, found.schema)
        if all(b.lower is not None for b in brackets):
            break
        found = _narrow(_inside(values, found, group), group, _LINEAR_CELL)

    wide = [
        F.expr(f"max(CASE WHEN measure = '{m}' THEN (lower + upper) / 2 END) AS {m}")
        for m in measures
    ]
    return found.groupBy(*keys).agg(*wide)


def _inside(values: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Values in the bracket of their group; one row per group, so it is broadcast."""
    same = " AND ".join(f"v.{c} <=> f.{c}" for c in group)
    return (
        values.alias("v")
        .join(
            F.broadcast(found).alias("f"),
            F.expr(f"{same} AND v.value BETWEEN f.lo AND f.hi"),
        )
        .select("v.*", "f.lo", "f.hi", "f.below", "f.total", "f.lower", "f.upper")
    )


def _narrow(values: DataFrame, group: list[str], cell: str) -> DataFrame:
    """Count values per cell and keep the cell (or the two cells) of the middle ranks."""
    by = ", ".join(group)
    cells = (
        values.withColumn("cell", F.expr(cell))
        .groupBy(*group, "below", "total", "lower", "upper", "cell")
        .agg(
            F.expr("count(1) AS n"),
            F.expr("min(value) AS cell_lo"),
            F.expr("max(value) AS cell_hi"),
        )
    )
    in_order = f"PARTITION BY {by} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND"
    ranked = cells.withColumns(
        {
            "total": F.expr(f"coalesce(total, sum(n) OVER ({in_order} UNBOUNDED FOLLOWING))"),
            "upto": F.expr(f"below + sum(n) OVER ({in_order} CURRENT ROW)"),
        }
    )
    # The middle ranks are equal for an odd total and neighbours for an even one.
    # A group that is settled stays in the next pass through one of its values.
    middle = "upto - n < total div 2 + 1 AND upto >= (total + 1) div 2"
    picked = (
        ranked.where(f"lower IS NOT NULL OR ({middle})")
        .groupBy(*group, "total", "lower", "upper")
        .agg(
            F.expr("min(upto - n) AS below"),
            F.expr("count(1) AS cells"),
            F.expr("min(cell_lo) AS first_lo"),
            F.expr("min(cell_hi) AS first_hi"),
            F.expr("max(cell_lo) AS last_lo"),
        )
    )
    # Two cells: the ranks are the end of the first and the start of the second.
    # One cell of equal values: both ranks have that value. Else go on inside it.
    settled = "(cells = 2 OR first_lo = first_hi)"
    lower = f"coalesce(lower, CASE WHEN {settled} THEN first_hi END)"
    return picked.selectExpr(
        *group,
        "total",
        "below",
        f"{lower} AS lower",
        f"coalesce(upper, CASE WHEN {settled} THEN last_lo END) AS upper",
        f"coalesce({lower}, first_lo) AS lo",
        f"coalesce({lower}, first_hi) AS hi",
    )
