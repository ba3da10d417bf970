"""The analytic panel: eligible firm-years with the attributes of their firm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.config import (
    FOREIGN_LEVELS,
    OWNERSHIP_LEVELS,
    SIZE_LEVELS,
    PanelConfig,
)
from firmlens.functions import features as fx
from firmlens.operators.firms import eligible_firms
from firmlens.operators.rows import panel_metrics, sample_columns, scaled, within_margins
from firmlens.operators.skew import attach_by_key


def merged_panel(source: DataFrame, firms: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Eligible firm-years, each with the attributes of its eligible firm.

    `firms` is the result of `firm_codes`, matched many to one. A firm without attributes (excluded or
    NULL id) would fail the eligibility filter, so the join is an inner one.
    """
    attributes = eligible_firms(firms, cfg).drop("liquidation")
    rows = panel_metrics(source, cfg).where(within_margins(cfg))
    joined = attach_by_key(rows, attributes, ["id"], "row_count", cfg.hot_rows).drop("row_count")
    return with_labels(scaled(joined), cfg)


def with_labels(df: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Turn the attribute codes (and the period code, if there) into factor labels."""
    levels = {
        "size": SIZE_LEVELS,
        "foreign": FOREIGN_LEVELS,
        "ownership": OWNERSHIP_LEVELS,
        "covid_period": list(enumerate(cfg.period_labels, start=1)),
    }
    return df.withColumns(
        {c: fx.label_of(c, lv) for c, lv in levels.items() if c in df.columns}
    )


def regression_sample(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """One row per dependent variable and firm-year in its estimation sample."""
    keys = ["id", "year", "covid_period", "size", "foreign", "ownership"]
    long = sample_columns(panel, cfg).unpivot(keys, list(cfg.depvars), "depvar", "y")
    return long.where("y IS NOT NULL").select("depvar", "y", *keys)
