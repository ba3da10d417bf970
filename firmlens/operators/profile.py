"""The firm table: one grouped pass from which all firm-level results are projections.

What a report or a model needs to know about a firm is a sum, a maximum or a count over the
firm's rows. One aggregation by firm holds them side by side: attribute codes, row and year
counts, and for every model and period the count, sum and square sum of the dependent
variable. So no firm-year is joined, sorted, expanded or demeaned for it. Spark leaves out
the aggregates that a reader of the unwritten table does not ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.config import PanelConfig
from firmlens.operators.firms import code_aggregates, eligible_firms
from firmlens.operators.panel import with_labels
from firmlens.operators.rows import (
    not_excluded,
    sample_columns,
    scaled,
    statement_rows,
    with_codes,
    with_metrics,
    within_margins,
)


def _rows(source: DataFrame, cfg: PanelConfig) -> DataFrame:
    """All rows of the window with codes, metrics and the row eligibility flag."""
    rows = with_metrics(with_codes(statement_rows(source, cfg), cfg), cfg)
    return rows.where(not_excluded(cfg)).withColumn("eligible", within_margins(cfg))


def firm_table(source: DataFrame, cfg: PanelConfig) -> DataFrame:
    """One row per firm: id, attribute codes, liquidation, row_count (rows in the window), n_obs
    (eligible rows), years_m (their distinct years as bits), and per model j a struct m_j with
    n_p, s_p and q_p of each period p: count, sum and sum of squares around their mean.
    """
    rows = sample_columns(
        scaled(_rows(source, cfg)), cfg, "eligible AND covid_period IS NOT NULL"
    )
    return rows.groupBy("id").agg(
        *code_aggregates(),
        F.count(F.lit(1)).alias("row_count"),
        F.expr("count_if(eligible) AS n_obs"),
        *year_masks(cfg),
        *[_period_moments(depvar, cfg).alias(f"m_{j}") for j, depvar in enumerate(cfg.depvars)],
    )


def _period_moments(depvar: str, cfg: PanelConfig) -> F.Column:
    moments = []
    for p in range(len(cfg.periods)):
        y = f"CASE WHEN covid_period = {p + 1} THEN `{depvar}` END"
        moments += [
            f"cast(count({y}) AS double) AS n_{p}",
            f"coalesce(sum({y}), 0D) AS s_{p}",
            f"coalesce(var_pop({y}) * count({y}), 0D) AS q_{p}",
        ]
    return F.expr(f"struct({', '.join(moments)})")


def firm_codes(table: DataFrame) -> DataFrame:
    """Attributes without the name; `row_count` is the firm's rows in the window."""
    return table.select("id", "size", "foreign", "ownership", "liquidation", "row_count")


def firm_profiles(table: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Eligible firms with at least one eligible row, from the firm table.

    Columns: id, size, foreign, ownership (labels), n_obs (eligible rows) and
    n_years (distinct years of those).
    """
    masks = range(len(year_masks(cfg)))
    counted = " + ".join(f"coalesce(bit_count(years_{m}), 0)" for m in masks)
    panel_firms = eligible_firms(table, cfg).where("n_obs > 0")
    return with_labels(
        panel_firms.selectExpr(
            "id", "size", "foreign", "ownership", "n_obs", f"{counted} AS n_years"
        ),
        cfg,
    )


def year_masks(cfg: PanelConfig) -> list[F.Column]:
    """Distinct years as bits, in one mask per 60 years of the window."""
    return [
        F.expr(
            f"bit_or(CASE WHEN eligible AND year BETWEEN {first} AND {first + 59} "
            f"THEN shiftleft(1L, year - {first}) END) AS years_{m}"
        )
        for m, first in enumerate(range(cfg.first_year, cfg.year_before, 60))
    ]


def firm_moments(table: DataFrame, cfg: PanelConfig) -> DataFrame:
    """One row per (depvar, firm) in the sample, from the firm table: counts, mean and deviations.

    With y the dependent variable and p, q periods: n, y_mean, ss_in = sum of squares around
    the period means, ss = sum of squares around y_mean, n_p, w_p = sum of y - y_mean in p,
    and of dummy periods the demeaned cross product g_pq = n_p [p = q] - n_p n_q / n.
    """
    periods = range(len(cfg.periods))
    fields = [f"m_{{j}}.{c}_{p} AS {c}_{p}" for c in "nsq" for p in periods]
    models = ", ".join(
        f"struct('{depvar}' AS depvar, {', '.join(fields).format(j=j)})"
        for j, depvar in enumerate(cfg.depvars)
    )
    long = eligible_firms(table, cfg).selectExpr(
        "id", "size", "foreign", "ownership", f"inline(array({models}))"
    )
    total = " + ".join
    long = long.withColumns(
        {
            "n": F.expr(total(f"n_{p}" for p in periods)),
            "ss_in": F.expr(total(f"q_{p}" for p in periods)),
        }
    ).where("n > 0")
    long = long.withColumn("y_mean", F.expr(f"({total(f's_{p}' for p in periods)}) / n"))
    # A code that is no level has no label and leaves the model.
    labelled = with_labels(long, cfg).where(
        "size IS NOT NULL AND foreign IS NOT NULL AND ownership IS NOT NULL"
    )
    labelled = labelled.withColumns({f"w_{p}": F.expr(f"s_{p} - n_{p} * y_mean") for p in periods})
    between = total(f"coalesce(try_divide(w_{p} * w_{p}, n_{p}), 0D)" for p in periods)
    products = [
        f"{f'n_{p}' if p == q else '0D'} - n_{p} * n_{q} / n AS g_{p}{q}" for p, q in pairs(cfg)
    ]
    return labelled.selectExpr(
        "depvar", "id", "size", "foreign", "ownership",
        "n", "y_mean", "ss_in", f"ss_in + {between} AS ss",
        *[f"n_{p}" for p in periods], *[f"w_{p}" for p in periods], *products,
    )


def dummies(cfg: PanelConfig) -> range:
    """Positions of the periods that get a dummy (all but the baseline)."""
    return range(1, len(cfg.periods))


def pairs(cfg: PanelConfig) -> list[tuple[int, int]]:
    return [(p, q) for p in dummies(cfg) for q in dummies(cfg) if p <= q]
