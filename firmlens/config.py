"""Parameters of a panel study: windows, bands, factor levels and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

# Code -> label, first entry is the regression baseline.
SIZE_LEVELS = ((3, "Medium"), (2, "Small"), (1, "Micro"), (4, "Large"))
OWNERSHIP_LEVELS = (
    (2, "Private"),
    (1, "Socialistic"),
    (3, "Cooperative"),
    (4, "Mixed"),
    (5, "Government"),
)
FOREIGN_LEVELS = ((0, "0"), (1, "1"))

# Size labels in code order 1..4.
SIZE_NAMES = ("Micro", "Small", "Medium", "Large")

# Upper band limits (head count; revenue and assets in thousand EUR).
EMPLOYEE_LIMITS = (10, 50, 250)
REVENUE_LIMITS_EUR = (700, 8000, 40000)
ASSET_LIMITS_EUR = (350, 4000, 20000)

# Dependent variable -> (panel column, positive values only).
DEPENDENT_VARIABLES = {
    "logOperatingRevenue": ("log_operating_revenue", True),
    "OperatingRevenue_mil": ("operating_revenue_mil", True),
    "logTotalRevenue": ("log_total_revenue", True),
    "TotalRevenue_mil": ("total_revenue_mil", True),
    "Assets_mil": ("assets_mil", True),
    "OperatingMargin_pct": ("operating_margin_pct", False),
    "NetMargin_pct": ("net_margin_pct", False),
}


@dataclass(frozen=True)
class PanelConfig:
    """One study. Defaults are the published study's values."""

    eur: float = 117.50
    year_after: int = 2017
    year_before: int = 2024
    excluded_id: int = 7777663
    # (label, first year, last year); the first period is the baseline.
    periods: tuple[tuple[str, int, int], ...] = (
        ("Pre", 2018, 2019),
        ("Covid", 2020, 2021),
        ("Post", 2022, 2023),
    )
    ownership_asset_years: tuple[int, int] = (2021, 2023)
    liquidation_pattern: str = "U STEČAJU|U LIKVIDACIJI"
    default_size: int = 3
    default_ownership: int = 2
    size_above: int = 2
    excluded_ownership: int = 1
    margin_bound: float = 1.0
    # Upper band limits of the size classes: head count, revenue and assets in thousand EUR.
    employee_limits: tuple[float, ...] = EMPLOYEE_LIMITS
    revenue_limits_eur: tuple[float, ...] = REVENUE_LIMITS_EUR
    asset_limits_eur: tuple[float, ...] = ASSET_LIMITS_EUR
    # The models: (name, panel column, positive values only).
    dependent_variables: tuple[tuple[str, str, bool], ...] = tuple(
        (name, *of) for name, of in DEPENDENT_VARIABLES.items()
    )
    # Small-sample factor n/(n-k): k counts the slopes, or slopes plus firm effects.
    hc1_k: str = "slopes"
    # The rows of a firm with more than these are not shuffled to meet it.
    hot_rows: int = 1_000_000
    # What a repeated (firm, year) key does to the models: "allow" or "refuse".
    duplicate_keys: str = "refuse"

    def __post_init__(self):
        if self.hc1_k not in ("slopes", "slopes+firms"):
            raise ValueError("hc1_k must be 'slopes' or 'slopes+firms'")
        if self.duplicate_keys not in ("allow", "refuse"):
            raise ValueError("duplicate_keys must be 'allow' or 'refuse'")

    @property
    def depvars(self) -> tuple[str, ...]:
        return tuple(name for name, _, _ in self.dependent_variables)

    @property
    def first_year(self) -> int:
        return self.year_after + 1

    @property
    def n_years(self) -> int:
        return self.year_before - self.year_after - 1

    @property
    def period_labels(self) -> tuple[str, ...]:
        return tuple(label for label, _, _ in self.periods)

    @property
    def size_levels(self) -> tuple[tuple[int, str], ...]:
        """Levels that can pass the size filter, baseline first."""
        return tuple(lv for lv in SIZE_LEVELS if lv[0] > self.size_above)

    @property
    def ownership_levels(self) -> tuple[tuple[int, str], ...]:
        return tuple(lv for lv in OWNERSHIP_LEVELS if lv[0] != self.excluded_ownership)


# The study moved to the years of the TPC-H-like tables.
STAND_IN = PanelConfig(
    year_after=1994,
    year_before=2001,
    excluded_id=13,
    periods=(("Pre", 1995, 1996), ("Covid", 1997, 1998), ("Post", 1999, 2000)),
    ownership_asset_years=(1998, 2000),
)
