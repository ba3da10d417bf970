"""The panel study: every report as a DataFrame, and a full run with its sink."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.config import PanelConfig
from firmlens.functions import features as fx
from firmlens.functions.formats import round_half_even
from firmlens.operators import describe, firms, panel, profile, regression, rows, within
from firmlens.sources.sinks import materialize, release, write_csv
from firmlens.sources.statements import source_profile


# Panel columns that the summary reports read.
REPORTED = ("id", "year", "size", "ownership", *describe.SIZE_STAT_MEASURES.values())


class PanelStudy:
    """Reports of one statement table under one configuration.

    Reports are lazy, but for what they share: the first report of medians writes the
    measures, the first of a model fits all models. Call `materialized()` before asking for many
    reports, so that they read the written firms and measures, and `close()` once their
    results are used: it removes what the study wrote.

    `raw` is the table as it came, before it was typed; the source profile looks at it.
    """

    def __init__(
        self, source: DataFrame, cfg: PanelConfig | None = None, raw: DataFrame | None = None
    ):
        self.source = source
        self.raw = source if raw is None else raw
        self.cfg = cfg or PanelConfig()
        self.spark = source.sparkSession

    def materialized(self) -> PanelStudy:
        """The same study with its intermediate tables written once."""
        study = PanelStudy(self.source, self.cfg, self.raw)
        study.firm_table = study.firm_rows  # so that all reports read it
        study.measures  # writes them, joined with the written firms
        return study

    def close(self) -> None:
        """Remove the tables that this study and its runs wrote; reports can't be read after that."""
        for study in self.__dict__.pop("_ran", []):
            study.close()
        release(*(v for v in self.__dict__.values() if isinstance(v, DataFrame)))

    def __enter__(self) -> PanelStudy:
        return self

    def __exit__(self, *failure) -> None:
        self.close()

    # Intermediate tables

    @cached_property
    def firm_table(self) -> DataFrame:
        """All that is known of each firm, from one grouped pass."""
        return profile.firm_table(self.source, self.cfg)

    @cached_property
    def firm_rows(self) -> DataFrame:
        """The firm table written once, for what reads it more than once."""
        return materialize(self.firm_table, "firm_table")

    @property
    def firms(self) -> DataFrame:
        return profile.firm_codes(self.firm_table)

    @cached_property
    def code_rows(self) -> DataFrame:
        """The firm codes written once: the list of hot firms and the join both read them."""
        if "firm_rows" in self.__dict__:
            return profile.firm_codes(self.firm_rows)
        return materialize(self.firms, "firm_codes")

    @property
    def profiles(self) -> DataFrame:
        return profile.firm_profiles(self.firm_table, self.cfg)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.merged_panel(self.source, self.code_rows, self.cfg)

    @cached_property
    def measures(self) -> DataFrame:
        """Panel columns of the summary reports, written once: medians take three passes."""
        return materialize(self.panel.select(*REPORTED), "measures")

    @property
    def moments(self) -> DataFrame:
        """Moments of each firm and model, as a projection of the written firm table."""
        return profile.firm_moments(self.firm_rows, self.cfg)

    @cached_property
    def fits(self) -> list[regression.Fit]:
        if self.cfg.duplicate_keys == "refuse":
            profiles = profile.firm_profiles(self.firm_rows, self.cfg)
            surplus = describe.panel_key_check(profiles).first().surplus_rows
            if surplus:
                raise ValueError(f"{surplus} rows beyond one per firm and year, see repeated_keys()")
        return regression.fit_models(self.moments, self.cfg)

    # Source and firms

    def source_profile(self) -> DataFrame:
        return source_profile(self.raw)

    def _coded_rows(self) -> DataFrame:
        return rows.with_codes(rows.statement_rows(self.source, self.cfg), self.cfg)

    def liquidation_flags(self) -> DataFrame:
        return self._coded_rows().select("id", "year", "name", "liquidation")

    def size_class_rows(self) -> DataFrame:
        return self._coded_rows().select(
            "id", "year", "employees", "operating_revenue", "assets", "size"
        )

    def firm_attributes(self) -> DataFrame:
        return firms.firm_attributes(self.source, self.cfg).drop("name_uses")

    def firm_modal_name(self) -> DataFrame:
        return firms.firm_attributes(self.source, self.cfg).select("id", "name", "name_uses")

    def size_distribution(self) -> DataFrame:
        return describe.size_distribution(self.firms)

    def liquidation_size_distribution(self) -> DataFrame:
        return describe.liquidation_size_distribution(self.firms)

    # Panel

    def covid_period(self) -> DataFrame:
        periods = list(enumerate(self.cfg.period_labels, start=1))
        label = fx.label_of("covid_period", periods)
        return self.panel_metrics().select(
            "id", "year", "covid_period", label.alias("period_label")
        )

    def panel_metrics(self) -> DataFrame:
        return rows.panel_metrics(self.source, self.cfg)

    def panel_merged(self) -> DataFrame:
        return self.panel

    def quality_report(self) -> DataFrame:
        return describe.quality_report(self.profiles)

    def years_covered(self) -> DataFrame:
        return describe.years_covered(self.panel_metrics())

    def firm_size_distribution(self) -> DataFrame:
        return describe.firm_size_distribution(self.profiles)

    def ownership_distribution(self) -> DataFrame:
        return describe.ownership_distribution(self.profiles)

    def foreign_distribution(self) -> DataFrame:
        return describe.foreign_distribution(self.profiles)

    def panel_balance(self) -> DataFrame:
        return describe.panel_balance(self.profiles)

    def balanced_firms(self) -> DataFrame:
        return describe.balanced_firms(self.profiles, self.cfg)

    def panel_key_check(self) -> DataFrame:
        return describe.panel_key_check(self.profiles)

    def repeated_keys(self) -> DataFrame:
        return describe.duplicate_keys(self.panel)

    def size_stats(self) -> DataFrame:
        return describe.size_stats(self.measures)

    def assets_long(self) -> DataFrame:
        return describe.assets_long(self.measures)

    def assets_wide(self) -> DataFrame:
        return describe.assets_wide(self.measures, self.cfg)

    def assets_by_ownership(self) -> DataFrame:
        return describe.assets_by_ownership(self.measures, self.cfg)

    # Models

    def regression_sample(self) -> DataFrame:
        return panel.regression_sample(self.panel, self.cfg)

    def design_matrix(self) -> DataFrame:
        return within.design_matrix(self.panel, self.cfg)

    def within_transform(self) -> DataFrame:
        return within.within_transform(self.source, within.firm_means(self.firm_rows, self.cfg), self.cfg)

    def within_moments(self) -> DataFrame:
        return regression.moment_table(self.spark, self.fits, self.cfg)

    def aliased_terms(self) -> DataFrame:
        return regression.aliased_table(self.spark, self.fits, self.cfg)

    def firm_scores(self) -> DataFrame:
        return regression.firm_scores(self.moments, self.fits, self.cfg)

    def fe_cluster_cov(self) -> DataFrame:
        return regression.covariance_table(self.spark, self.fits, self.cfg)

    def fe_coefficients(self) -> DataFrame:
        """Estimates, clustered errors, t and p values and stars."""
        return regression.coefficient_table(self.spark, self.fits, self.cfg)

    def fe_models(self) -> DataFrame:
        """Unrounded model records."""
        return regression.summary_table(self.spark, self.fits)

    def fe_summary(self) -> DataFrame:
        """Model records rounded for display."""
        return self.fe_models().select(
            "depvar",
            "unit",
            "obs",
            "firms",
            round_half_even("r2", 4).alias("r2"),
            round_half_even("adj_r2", 4).alias("adj_r2"),
            round_half_even("f_stat", 2).alias("f_stat"),
        )

    REPORTS = (
        "source_profile",
        "size_distribution",
        "liquidation_size_distribution",
        "quality_report",
        "years_covered",
        "firm_size_distribution",
        "ownership_distribution",
        "foreign_distribution",
        "panel_balance",
        "balanced_firms",
        "panel_key_check",
        "size_stats",
        "assets_wide",
        "assets_by_ownership",
        "fe_coefficients",
        "fe_summary",
    )

    def run(self, output: str) -> dict[str, DataFrame]:
        """Make every printed report and write the model summary as CSV to `output`.

        The reports read tables that `close()` removes.
        """
        study = self.materialized()
        self.__dict__.setdefault("_ran", []).append(study)
        reports = {name: getattr(study, name)() for name in self.REPORTS}
        summary = reports["fe_summary"].select(
            F.col("depvar").alias("Variable"),
            F.col("obs").alias("Obs"),
            F.col("firms").alias("Firms"),
            F.col("r2").alias("R2"),
            F.col("adj_r2").alias("Adj_R2"),
            F.col("f_stat").alias("F_stat"),
        )
        write_csv(summary, output)
        return reports
