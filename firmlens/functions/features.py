"""Column builders: flags, classes, ratios, periods and labels. No DataFrames here.

Builders take column names and return one SQL expression each, which Spark parses
in a single call however many branches it has.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmlens.config import (
    SIZE_NAMES,
    PanelConfig,
)


def in_window(year: str, cfg: PanelConfig) -> Column:
    """Strict on both ends; a NULL year is dropped."""
    return F.expr(f"{year} > {cfg.year_after} AND {year} < {cfg.year_before}")


def liquidation_flag(name: str, cfg: PanelConfig) -> Column:
    """Case-sensitive match; a NULL name is no match."""
    return F.coalesce(F.col(name).rlike(cfg.liquidation_pattern), F.lit(False))


def foreign_flag(share: str) -> Column:
    return F.expr(f"coalesce({share} > 0, false)")


def ownership_code(code: str, cfg: PanelConfig) -> Column:
    return F.expr(f"cast(coalesce({code}, {cfg.default_ownership}) AS int)")


def size_class(employees: str, revenue: str, assets: str, cfg: PanelConfig) -> Column:
    """Statutory class 1..4: the first band that wins two of three criteria.

    Missing inputs and rows without a winning band get the default class.
    """
    criteria = (
        (employees, cfg.employee_limits),
        (revenue, [x * cfg.eur for x in cfg.revenue_limits_eur]),
        (assets, [x * cfg.eur for x in cfg.asset_limits_eur]),
    )
    missing = " OR ".join(f"{column} IS NULL" for column, _ in criteria)
    bands = []
    for band, _ in enumerate(SIZE_NAMES):
        votes = " + ".join(
            f"cast({_in_band(column, limits, band)} AS int)" for column, limits in criteria
        )
        bands.append(f"WHEN {votes} >= 2 THEN {band + 1}")
    return F.expr(
        f"CASE WHEN {missing} THEN {cfg.default_size} {' '.join(bands)} ELSE {cfg.default_size} END"
    )


def _in_band(column: str, limits, band: int) -> str:
    """Lower limit exclusive, upper limit inclusive; the outer bands are open."""
    above = [f"{column} > {float(limits[band - 1])}D"] if band > 0 else []
    below = [f"{column} <= {float(limits[band])}D"] if band < len(limits) else []
    return "(" + " AND ".join(above + below) + ")"


def net_of(income: str, loss: str) -> Column:
    """Income minus loss, each counting as zero where missing."""
    return F.expr(f"coalesce({income}, 0D) - coalesce({loss}, 0D)")


def period_code(year: str, cfg: PanelConfig) -> Column:
    """1-based period of a year; NULL outside every period."""
    spans = " ".join(
        f"WHEN {year} BETWEEN {first} AND {last} THEN {i}"
        for i, (_, first, last) in enumerate(cfg.periods, start=1)
    )
    return F.expr(f"CASE {spans} END")


def label_of(code: str, levels) -> Column:
    """Factor label of a code; NULL for a code that is no level."""
    branches = " ".join(f"WHEN {value} THEN '{label}'" for value, label in levels)
    return F.expr(f"CASE {code} {branches} END")


def level_order(label: str, levels) -> Column:
    """Display position of a label, the baseline first."""
    branches = " ".join(f"WHEN '{text}' THEN {i}" for i, (_, text) in enumerate(levels))
    return F.expr(f"CASE {label} {branches} END")


def size_name(size: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIZE_NAMES]), F.col(size))


def unit_caption(depvar: str) -> Column:
    return F.when(F.col(depvar).rlike("_mil$"), "RSD millions").when(
        F.col(depvar).rlike("_pct$"), "percentage points"
    )


def significance_stars(p: str) -> Column:
    return F.expr(
        f"CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0.001D THEN '***' WHEN {p} <= 0.01D THEN '**' "
        f"WHEN {p} <= 0.05D THEN '*' WHEN {p} <= 0.1D THEN '.' ELSE '' END"
    )
