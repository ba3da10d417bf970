"""Firm-year rows: the window, business names, attribute codes and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.config import PanelConfig
from firmlens.functions import features as fx

METRIC_COLUMNS = (
    "id",
    "year",
    "operating_revenue",
    "total_revenue",
    "operating_income",
    "operating_loss",
    "net_income",
    "net_loss",
    "assets",
    "operating_result",
    "net_result",
    "operating_margin",
    "net_margin",
    "log_operating_revenue",
    "log_total_revenue",
    "covid_period",
)


def statement_rows(source: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Statements of the year window under business names."""
    return source.where(fx.in_window("year", cfg)).selectExpr(
        "mb AS id",
        "year",
        "name",
        "AOP1001 AS operating_revenue",
        "AOP1043 AS total_revenue",
        "AOP1025 AS operating_income",
        "AOP1026 AS operating_loss",
        "AOP1055 AS net_income",
        "AOP1064 AS net_loss",
        "AOP59 AS assets",
        "AOP9005 AS employees",
        "AOP9002 AS ownership_code",
        "AOP9003 AS foreign_share",
    )


def with_codes(rows: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Add the per-year attribute codes of the firm."""
    return rows.withColumns(
        {
            "size": fx.size_class("employees", "operating_revenue", "assets", cfg),
            "foreign": fx.foreign_flag("foreign_share"),
            "ownership": fx.ownership_code("ownership_code", cfg),
            "liquidation": fx.liquidation_flag("name", cfg),
        }
    )


def with_metrics(rows: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Add results, margins, logs and the period code."""
    return rows.withColumns(
        {
            "operating_result": fx.net_of("operating_income", "operating_loss"),
            "net_result": fx.net_of("net_income", "net_loss"),
        }
    ).withColumns(
        {
            "operating_margin": F.expr("try_divide(operating_result, operating_revenue)"),
            "net_margin": F.expr("try_divide(net_result, operating_revenue)"),
            "log_operating_revenue": F.ln("operating_revenue"),
            "log_total_revenue": F.ln("total_revenue"),
            "covid_period": fx.period_code("year", cfg),
        }
    )


def scaled(rows: DataFrame) -> DataFrame:
    """Add the measures in millions and percentage points."""
    return rows.withColumns(
        {
            "operating_revenue_mil": F.expr("operating_revenue / 1000"),
            "total_revenue_mil": F.expr("total_revenue / 1000"),
            "assets_mil": F.expr("assets / 1000"),
            "operating_margin_pct": F.expr("operating_margin * 100"),
            "net_margin_pct": F.expr("net_margin * 100"),
        }
    )


def panel_metrics(source: DataFrame, cfg: PanelConfig) -> DataFrame:
    return with_metrics(statement_rows(source, cfg), cfg).select(*METRIC_COLUMNS)


def not_excluded(cfg: PanelConfig) -> Column:
    """The excluded firm goes, and so does a NULL id (NULL != x is not true)."""
    return F.col("id") != cfg.excluded_id


def within_margins(cfg: PanelConfig) -> Column:
    """Both margins strictly inside the bound; a NULL margin is not."""
    bound = float(cfg.margin_bound)
    return F.expr(
        f"coalesce(abs(operating_margin) < {bound}D AND abs(net_margin) < {bound}D, false)"
    )


def sample_columns(rows: DataFrame, cfg: PanelConfig, in_sample: str = "true") -> DataFrame:
    """Add one column per dependent variable, NULL where a row is not in its sample.

    For the logs the positivity filter acts on the logged value.
    """
    return rows.withColumns(
        {
            depvar: F.expr(
                f"CASE WHEN {in_sample} {f'AND {column} > 0' if positive else ''} THEN {column} END"
            )
            for depvar, column, positive in cfg.dependent_variables
        }
    )
