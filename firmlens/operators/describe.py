"""Descriptive reports over firm profiles and the merged panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.config import OWNERSHIP_LEVELS, SIZE_LEVELS, PanelConfig
from firmlens.functions import features as fx
from firmlens.functions.formats import mean_median_text, percentage, round_half_even
from firmlens.operators.medians import exact_medians


def frequency(df: DataFrame, key: str) -> DataFrame:
    """Count per level and its share of the total. Empty levels do not appear.

    The window runs over the counted levels, a handful of rows.
    """
    everything = Window.partitionBy()
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.sum("n").over(everything))
        .withColumn("percentage", percentage("n", "total"))
    )


def size_distribution(firms: DataFrame) -> DataFrame:
    """All firms by size code; without any firm one row that says so, with no size."""
    counted = frequency(firms, "size").withColumn("size_label", fx.size_name("size"))
    counted = counted.select(
        "size", "size_label", "n", "percentage", F.col("total").alias("total_firms")
    )
    none = firms.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    none = none.select(
        *(
            F.col("n").alias(c) if c in ("n", "total_firms") else F.lit(None).cast(kind).alias(c)
            for c, kind in counted.dtypes
        )
    )
    return counted.unionByName(none).orderBy("size")


def liquidation_size_distribution(firms: DataFrame) -> DataFrame:
    """Firms in liquidation by size code; without any one row that counts 0."""
    return size_distribution(firms.where("liquidation")).withColumnRenamed(
        "total_firms", "liquidated_firms"
    )


def quality_report(profiles: DataFrame) -> DataFrame:
    """Observations and firms of the merged panel."""
    return profiles.agg(
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("observations"),
        F.count(F.lit(1)).alias("firms"),
    )


def years_covered(metrics: DataFrame) -> DataFrame:
    """Distinct years of the metric panel in one text; the window bounds their number."""
    years = F.array_sort(F.collect_set("year"))
    return metrics.agg(F.array_join(years.cast("array<string>"), ", ").alias("years"))


def firm_size_distribution(profiles: DataFrame) -> DataFrame:
    """Panel firms by size. A profile row is one firm, so levels are plainly counted."""
    return (
        frequency(profiles, "size")
        .orderBy(fx.level_order("size", SIZE_LEVELS).asc_nulls_last())
        .select("size", "n", F.col("size").alias("size_label"), "percentage")
    )


def ownership_distribution(profiles: DataFrame) -> DataFrame:
    return (
        frequency(profiles, "ownership")
        .orderBy(F.desc("n"), fx.level_order("ownership", OWNERSHIP_LEVELS).asc_nulls_last())
        .select("ownership", "n", "percentage")
    )


def foreign_distribution(profiles: DataFrame) -> DataFrame:
    label = F.when(F.col("foreign") == "1", "Foreign").otherwise("Domestic")
    return (
        frequency(profiles, "foreign")
        .orderBy("foreign")
        .select(label.alias("foreign_label"), "n", "percentage")
    )


def panel_balance(profiles: DataFrame) -> DataFrame:
    """Firms by number of distinct years."""
    return profiles.groupBy("n_years").agg(F.count(F.lit(1)).alias("n")).orderBy("n_years")


def balanced_firms(profiles: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Number of firms with a row in every year of the window."""
    return panel_balance(profiles).where(F.col("n_years") == cfg.n_years).select(
        F.col("n").alias("balanced_firms")
    )


def panel_key_check(profiles: DataFrame) -> DataFrame:
    """One row: panel rows, distinct (firm, year) keys and rows beyond one per key."""
    observations = F.coalesce(F.sum("n_obs"), F.lit(0))
    keys = F.coalesce(F.sum("n_years"), F.lit(0))
    return profiles.agg(
        observations.alias("observations"),
        keys.alias("distinct_keys"),
        (observations - keys).alias("surplus_rows"),
    )


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """The (firm, year) keys that occur more than once."""
    return (
        panel.groupBy("id", "year")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


# Report name -> panel column of the size statistics.
SIZE_STAT_MEASURES = {
    "revenue": "operating_revenue_mil",
    "tot_revenue": "total_revenue_mil",
    "assets": "assets_mil",
    "op_margin": "operating_margin_pct",
}


def size_stats(panel: DataFrame) -> DataFrame:
    """Firms, rows, means and exact medians by size."""
    columns = list(SIZE_STAT_MEASURES.values())
    # Rows collapse to one per (size, firm) first, so firms are counted in parallel.
    by_firm = panel.groupBy("size", "id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"sum({c}) AS {c}_sum") for c in columns],
        *[F.expr(f"count({c}) AS {c}_n") for c in columns],
    )
    totals = by_firm.groupBy("size").agg(
        F.count(F.lit(1)).alias("n_firms"),
        F.sum("n").alias("n_obs"),
        *[F.expr(f"try_divide(sum({c}_sum), sum({c}_n)) AS {c}_mean") for c in columns],
    )
    medians = exact_medians(panel, ["size"], columns)
    joined = _with_medians(totals, medians, ["size"])
    stats = []
    for name, column in SIZE_STAT_MEASURES.items():
        stats += [
            round_half_even(f"{column}_mean", 2).alias(f"mean_{name}"),
            round_half_even(column, 2).alias(f"median_{name}"),
        ]
    return joined.orderBy(fx.level_order("size", SIZE_LEVELS).asc_nulls_last()).select(
        "size", "n_firms", "n_obs", *stats
    )


def assets_long(panel: DataFrame) -> DataFrame:
    """Mean and median assets by year and size, with the display text of each cell."""
    joined = _assets_by(panel, ["year", "size"])
    return joined.orderBy("year", fx.level_order("size", SIZE_LEVELS).asc_nulls_last()).select(
        "year",
        "size",
        round_half_even("mean", 1).alias("mean_assets"),
        round_half_even("assets_mil", 1).alias("median_assets"),
        F.col("n").alias("observations"),
        mean_median_text("mean", "assets_mil", "n").alias("assets"),
    )


def assets_wide(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """The cells of `assets_long` with one column per size; 'N/A' where there is none."""
    sizes = [label for _, label in cfg.size_levels]
    cells = _assets_by(panel, ["year", "size"]).withColumn(
        "assets", mean_median_text("mean", "assets_mil", "n")
    )
    return (
        cells.groupBy("year")
        .pivot("size", sizes)
        .agg(F.first("assets"))
        .fillna("N/A", sizes)
        .orderBy("year")
    )


def assets_by_ownership(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Mean and median assets by ownership over the configured years, largest mean first."""
    rows = panel.where(F.col("year").between(*cfg.ownership_asset_years))
    order = fx.level_order("ownership", OWNERSHIP_LEVELS).asc_nulls_last()
    return (
        _assets_by(rows, ["ownership"])
        .select(
            "ownership",
            round_half_even("mean", 1).alias("mean_assets"),
            round_half_even("assets_mil", 1).alias("median_assets"),
            F.col("n").alias("observations"),
        )
        .orderBy(F.desc("mean_assets"), order)
    )


def _assets_by(panel: DataFrame, keys: list[str]) -> DataFrame:
    means = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("assets_mil").alias("mean")
    )
    return _with_medians(means, exact_medians(panel, keys, ["assets_mil"]), keys)


def _with_medians(stats: DataFrame, medians: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides have one row per combination of factor levels, hence a broadcast."""
    same = " AND ".join(f"s.{k} <=> m.{k}" for k in keys)
    values = [f"m.{c}" for c in medians.columns if c not in keys]
    joined = stats.alias("s").join(F.broadcast(medians).alias("m"), F.expr(same), "left")
    return joined.select("s.*", *values)
