"""One row per firm: size class, ownership, foreign share, liquidation, modal name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.config import PanelConfig
from firmlens.operators.rows import not_excluded, statement_rows, with_codes


def code_aggregates() -> list[Column]:
    """Firm attributes as aggregates over its years."""
    return [
        F.expr("max(size) AS size"),
        F.expr("max(cast(foreign AS int)) AS foreign"),
        F.expr("max(ownership) AS ownership"),
        F.expr("bool_or(liquidation) AS liquidation"),
    ]


def firm_attributes(source: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Attributes with the most frequent name; ties go to the first name in order.

    Rows collapse by (id, name) before they collapse by id, so the names of one
    firm are counted in parallel and no join brings the name back.
    """
    by_name = (
        with_codes(statement_rows(source, cfg), cfg)
        .where(not_excluded(cfg))
        .groupBy("id", "name")
        .agg(*code_aggregates(), F.count("name").alias("uses"))
    )
    return by_name.groupBy("id").agg(
        *code_aggregates(),
        F.expr("min_by(name, struct(-uses, name)) AS name"),
        F.max("uses").alias("name_uses"),
    )


def eligible_firms(firms: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Going concerns above the size floor, without the excluded ownership type."""
    return firms.where(
        f"NOT liquidation AND size > {cfg.size_above} "
        f"AND ownership != {cfg.excluded_ownership}"
    )
