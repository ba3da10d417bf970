"""Row forms of the model matrix: the dummies and their firm-demeaned values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.config import PanelConfig
from firmlens.operators.firms import eligible_firms
from firmlens.operators.panel import with_labels
from firmlens.operators.profile import dummies
from firmlens.operators.regression import Term, model_terms
from firmlens.operators.rows import panel_metrics, sample_columns, scaled, within_margins
from firmlens.operators.skew import attach_by_key


def design_matrix(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """0/1 columns of the slopes for every panel row."""
    columns = [
        _of_level(t, f"CASE WHEN covid_period = '{cfg.period_labels[t.period]}' THEN 1D ELSE 0D END")
        for t in model_terms(cfg)
    ]
    return panel.selectExpr("id", "year", *columns)


def _of_level(t: Term, value: str) -> str:
    """SQL: `value` for firms of the term's attribute level, zero for others."""
    if t.attribute is not None:
        value = f"CASE WHEN {t.attribute} = '{t.level}' THEN {value} ELSE 0D END"
    return f"{value} AS {t.column}"


def firm_means(table: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Firms of any sample with their means of every model, as a projection of the firm table."""
    models = []
    for j, depvar in enumerate(cfg.depvars):
        n, total = (" + ".join(f"m_{j}.{c}_{p}" for p in range(len(cfg.periods))) for c in "ns")
        counts = ", ".join(f"m_{j}.n_{p} AS n_{p}" for p in dummies(cfg))
        mean = f"try_divide({total}, {n})"
        models.append(f"struct('{depvar}' AS depvar, {n} AS n, {mean} AS y_mean, {counts})")
    means = f"filter(array({', '.join(models)}), m -> m.n > 0) AS means"
    firms = eligible_firms(table, cfg).selectExpr(
        "id", "size", "foreign", "ownership", "row_count", means
    )
    return with_labels(firms, cfg).where(
        "size(means) > 0 AND size IS NOT NULL AND foreign IS NOT NULL AND ownership IS NOT NULL"
    )


def within_transform(source: DataFrame, firms: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Sample rows of every model with y and regressors minus their firm means.

    `firms` is the result of `firm_means` on a written firm table, one set per model, so rows meet their firm
    once and are laid out by model afterwards. The firm mean of (period p) x
    (level z) is z n_p / n.
    """
    rows = sample_columns(
        scaled(panel_metrics(source, cfg).where(within_margins(cfg))), cfg, "covid_period IS NOT NULL"
    ).select("id", "year", "covid_period", *cfg.depvars)
    joined = attach_by_key(rows, firms, ["id"], "row_count", cfg.hot_rows)
    y = " ".join(f"WHEN '{d}' THEN {d}" for d in cfg.depvars)
    sample = (
        joined.select("*", F.expr("inline(means)"))
        .withColumn("y", F.expr(f"CASE depvar {y} END"))
        .where("y IS NOT NULL")
    )
    return sample.selectExpr(
        "depvar",
        "id",
        "year",
        "y - y_mean AS y",
        *[
            _of_level(t, f"cast(covid_period = {t.period + 1} AS double) - n_{t.period} / n")
            for t in model_terms(cfg)
        ],
    )
