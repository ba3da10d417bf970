"""Firm fixed-effects models with period interactions and firm-clustered errors.

Every regressor is (period dummy) x (firm attribute dummy), so the demeaned cross
products of a firm depend on its rows only through the period counts and period
sums of `firm_moments`. Their products, summed over the firms that share an
attribute profile, determine the slopes. A second pass over the written moments takes each
firm's residual sums, and from them the residual square sum, as a sum of parts that are not
negative, and the clustered covariance. What reaches the driver is one row per
(dependent variable, attribute profile), whatever the number of firms.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.config import (
    FOREIGN_LEVELS,
    OWNERSHIP_LEVELS,
    SIZE_LEVELS,
    PanelConfig,
)
from firmlens.functions import features as fx
from firmlens.functions.student_t import two_sided_p
from firmlens.operators.profile import dummies, pairs

# A regressor whose variation beyond earlier ones is below this share is collinear.
COLLINEAR_SHARE = 1e-10
# A residual share below this is rounding alone: the fit is exact and has no F.
EXACT_SHARE = 1e-27


@dataclass(frozen=True)
class Term:
    """Interaction of a dummy period with one attribute level (or with nothing)."""

    period: int
    attribute: str | None
    level: str | None
    name: str
    column: str

    def applies(self, profile: dict) -> bool:
        return self.attribute is None or profile[self.attribute] == self.level


def model_terms(cfg: PanelConfig) -> list[Term]:
    """Slopes of the model in display order: levels the eligibility filter lets pass."""
    attributes = {
        "size": [label for _, label in cfg.size_levels[1:]],
        "foreign": [label for _, label in FOREIGN_LEVELS[1:]],
        "ownership": [label for _, label in cfg.ownership_levels[1:]],
    }
    levels = [(None, None)] + [(a, lv) for a, labels in attributes.items() for lv in labels]
    terms = []
    for (attribute, level), p in itertools.product(levels, dummies(cfg)):
        period = cfg.period_labels[p]
        name, column = f"Covid_period{period}", period.lower()
        if attribute:
            name += f":{attribute.capitalize()}{level}"
            column += f"_{attribute}_{level.lower()}"
        terms.append(Term(p, attribute, level, name, column))
    return terms


def full_model_terms(cfg: PanelConfig) -> list[tuple[str, Term | None]]:
    """Every column of the model matrix by name, with its slope where it can have one."""
    by_name = {t.name: t for t in model_terms(cfg)}
    attributes = {
        "Size": [label for _, label in SIZE_LEVELS[1:]],
        "Foreign": [label for _, label in FOREIGN_LEVELS[1:]],
        "Ownership": [label for _, label in OWNERSHIP_LEVELS[1:]],
    }
    periods = [f"Covid_period{cfg.period_labels[p]}" for p in dummies(cfg)]
    levels = [f"{a}{lv}" for a, labels in attributes.items() for lv in labels]
    names = [*periods, *levels, *(f"{p}:{lv}" for lv in levels for p in periods)]
    return [(name, by_name.get(name)) for name in names]


PROFILE = ("size", "foreign", "ownership")


def profile_sums(moments: DataFrame, cfg: PanelConfig) -> DataFrame:
    """Sums of firm moments by (depvar, attribute profile)."""
    w = [f"w_{p}" for p in dummies(cfg)]
    g = [f"g_{p}{q}" for p, q in pairs(cfg)]
    return moments.groupBy("depvar", *PROFILE).agg(
        F.expr("cast(sum(n) AS bigint) AS obs"),
        F.expr("count(1) AS firms"),
        # Square sum of an attribute's own dummy around the firm mean.
        F.expr("sum(n - n * n / n) AS g_own"),
        *[F.expr(f"sum({c}) AS {c}") for c in ("ss", *w, *g)],
    )


@dataclass
class Fit:
    """One estimated model. Aliased terms have no estimate."""

    depvar: str
    obs: int
    firms: int
    tss: float
    rss: float
    gram: np.ndarray
    # Within-firm square sum of attribute main effects, by (attribute, level).
    own: dict
    xy: np.ndarray
    kept: np.ndarray
    status: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    # (size, foreign, ownership) -> slope of each dummy period for such a firm
    effects: dict = field(default_factory=dict)
    # Of the slopes.
    cov: np.ndarray | None = None

    @property
    def k(self) -> int:
        return int(self.kept.sum())

    @property
    def df(self) -> int:
        return self.obs - self.firms - self.k

    @property
    def r2(self) -> float | None:
        return 1.0 - self.rss / self.tss if self.tss > 0 else None

    @property
    def adj_r2(self) -> float | None:
        return adjusted_r2(self.r2, self.obs, self.df)

    @property
    def f_stat(self) -> float | None:
        if self.tss <= 0 or self.rss <= EXACT_SHARE * self.tss or self.df <= 0 or self.k == 0:
            return None
        return (self.tss - self.rss) / self.k / (self.rss / self.df)


def adjusted_r2(r2: float | None, obs: int, df: int) -> float | None:
    return None if r2 is None or df <= 0 else 1.0 - (1.0 - r2) * (obs - 1) / df


def f_statistic(r2: float | None, k: int, df: int) -> float | None:
    if r2 is None or df <= 0 or k == 0 or r2 >= 1.0:
        return None
    return (r2 / k) / ((1.0 - r2) / df)


def fit_models(moments: DataFrame, cfg: PanelConfig) -> list[Fit]:
    """Estimate every model, in two passes over the moments, which should be written.

    Each pass collects at most models x attribute profiles rows.
    """
    rows = [r.asDict() for r in profile_sums(moments, cfg).collect()]
    by_model = {d: [r for r in rows if r["depvar"] == d] for d in cfg.depvars}
    fits = [_slopes(d, profiles, cfg) for d, profiles in by_model.items() if profiles]
    return _with_residuals(moments, fits, cfg) if fits else []


def _slopes(depvar: str, profiles: list[dict], cfg: PanelConfig) -> Fit:
    terms = model_terms(cfg)
    size = len(terms)

    def g(p: int, q: int) -> str:
        return f"g_{min(p, q)}{max(p, q)}"

    gram, xy, own = np.zeros((size, size)), np.zeros(size), {}
    for row in profiles:
        for attribute in PROFILE:
            level = (attribute, row[attribute])
            own[level] = own.get(level, 0.0) + row["g_own"]
        for i, a in enumerate(terms):
            if a.applies(row):
                xy[i] += row[f"w_{a.period}"]
                for j, b in enumerate(terms):
                    if b.applies(row):
                        gram[i, j] += row[g(a.period, b.period)]

    kept, status = estimable(gram)
    beta, inverse = np.zeros(size), np.zeros((size, size))
    if kept.any():
        block = np.ix_(kept, kept)
        inverse[block] = np.linalg.inv(gram[block])
        beta[kept] = np.linalg.solve(gram[block], xy[kept])
    tss = math.fsum(r["ss"] for r in profiles)
    obs, firms = sum(r["obs"] for r in profiles), sum(r["firms"] for r in profiles)

    effects = {}
    for row in profiles:
        c = {p: 0.0 for p in dummies(cfg)}
        for slope, t in zip(beta, terms):
            if t.applies(row):
                c[t.period] += float(slope)
        effects[(row["size"], row["foreign"], row["ownership"])] = list(c.values())
    return Fit(depvar, obs, firms, tss, math.nan, gram, own, xy, kept, status, beta, inverse, effects)


def _with_residuals(moments: DataFrame, fits: list[Fit], cfg: PanelConfig) -> list[Fit]:
    """The fits with their residual square sum and firm-clustered covariance.

    With u_p the sum of a firm's residuals in period p, its square sum is ss_in plus u_p^2 / n_p
    over all periods, and its score for (p, z) is z u_p. Both are taken firm by firm before
    anything is added up, so that close fits keep their digits.
    """
    terms = model_terms(cfg)
    baseline = f"({' + '.join(f'u_{p}' for p in dummies(cfg))})" if dummies(cfg) else "0D"
    squares = [f"try_divide(u_{p} * u_{p}, n_{p})" for p in dummies(cfg)]
    # A firm's residuals add up to zero.
    squares.append(f"try_divide({baseline} * {baseline}, n_0)")
    rss = " + ".join(["ss_in", *(f"coalesce({s}, 0D)" for s in squares)])
    sums = _residual_sums(moments, fits, cfg).groupBy("depvar", *PROFILE).agg(
        F.expr(f"sum({rss}) AS rss"),
        *[F.expr(f"sum(u_{p} * u_{q}) AS u_{p}{q}") for p, q in pairs(cfg)],
    )
    rows = [r.asDict() for r in sums.collect()]  # at most models x attribute profiles
    out = []
    for f in fits:
        meat, own = np.zeros((len(terms), len(terms))), [r for r in rows if r["depvar"] == f.depvar]
        for row in own:
            for (i, a), (j, b) in itertools.product(enumerate(terms), repeat=2):
                if a.applies(row) and b.applies(row):
                    meat[i, j] += row[f"u_{min(a.period, b.period)}{max(a.period, b.period)}"]
        counted = f.k + (f.firms if cfg.hc1_k == "slopes+firms" else 0)
        factor = f.obs / (f.obs - counted) if f.obs > counted else math.nan
        cov = factor * f.inverse @ meat @ f.inverse
        out.append(replace(f, rss=math.fsum(r["rss"] for r in own), cov=cov))
    return out


def estimable(gram: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Go through the terms in order; drop those without variation of their own."""
    work, diagonal = gram.astype(float).copy(), np.diag(gram).astype(float).copy()
    kept, status = np.zeros(len(gram), dtype=bool), []
    for j, own in enumerate(diagonal):
        if own <= 0:
            status.append("no within variation")
        elif work[j, j] <= COLLINEAR_SHARE * own:
            status.append("collinear")
        else:
            status.append("kept")
            kept[j] = True
            work -= np.outer(work[:, j], work[j, :]) / work[j, j]
    return kept, status


def summary_table(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """One row per model: observations, firms, fit (unrounded) and unit."""
    rows = [
        (f.depvar, f.obs, f.firms, f.k, f.r2, f.adj_r2, f.f_stat) for f in fits
    ]
    schema = (
        "depvar string, obs bigint, firms bigint, slopes int, r2 double, adj_r2 double, f_stat double"
    )
    return spark.createDataFrame(rows, schema).withColumn("unit", fx.unit_caption("depvar"))


def coefficient_table(spark: SparkSession, fits: list[Fit], cfg: PanelConfig) -> DataFrame:
    """One row per estimated slope with its clustered error, t value, p value and stars."""
    rows = []
    for f in fits:
        for i, t in enumerate(model_terms(cfg)):
            if f.kept[i]:
                estimate, variance = float(f.beta[i]), float(f.cov[i, i])
                error = math.sqrt(variance) if variance >= 0 else None
                t_value = estimate / error if error else None
                p = two_sided_p(t_value, f.df) if t_value is not None and f.df > 0 else None
                rows.append((f.depvar, t.name, i, estimate, error, t_value, p))
    schema = (
        "depvar string, term string, position int, estimate double, std_error double, "
        "t_value double, p_value double"
    )
    return spark.createDataFrame(rows, schema).withColumn(
        "stars", fx.significance_stars("p_value")
    )


def covariance_table(spark: SparkSession, fits: list[Fit], cfg: PanelConfig) -> DataFrame:
    """Clustered covariance of the estimated slopes in long form."""
    terms = model_terms(cfg)
    rows = [
        (f.depvar, terms[i].name, terms[j].name, float(f.cov[i, j]))
        for f in fits
        for i, j in itertools.product(np.flatnonzero(f.kept), repeat=2)
    ]
    return spark.createDataFrame(rows, "depvar string, term_a string, term_b string, cov double")


def moment_table(spark: SparkSession, fits: list[Fit], cfg: PanelConfig) -> DataFrame:
    """Demeaned cross products of the regressors and the dependent variable."""
    names = [t.column for t in model_terms(cfg)]
    rows = []
    for f in fits:
        for i, a in enumerate(names):
            rows += [(f.depvar, a, b, float(f.gram[i, j])) for j, b in enumerate(names) if j >= i]
            rows.append((f.depvar, a, "y", float(f.xy[i])))
        rows.append((f.depvar, "y", "y", f.tss))
    return spark.createDataFrame(rows, "depvar string, a string, b string, value double")


def aliased_table(spark: SparkSession, fits: list[Fit], cfg: PanelConfig) -> DataFrame:
    """Every column of the model matrix, its variation within firms, and whether it has a slope.

    Attribute main effects are constant within a firm, and levels that the eligibility filter
    removes never occur, so they have none.
    """
    position = {t.name: i for i, t in enumerate(model_terms(cfg))}
    rows = []
    for f in fits:
        main = {f"{a.capitalize()}{level}": v for (a, level), v in f.own.items()}
        for name, term in full_model_terms(cfg):
            i = position[name] if term else None
            variation = float(f.gram[i, i]) if term else main.get(name, 0.0)
            status = f.status[i] if term else "varies" if variation > 0 else "no within variation"
            rows.append((f.depvar, name, variation, status))
    return spark.createDataFrame(rows, "depvar string, term string, within_ss double, status string")


def firm_scores(moments: DataFrame, fits: list[Fit], cfg: PanelConfig) -> DataFrame:
    """Score of every firm for every estimated slope: demeaned regressors times residuals."""
    terms = model_terms(cfg)
    scored = _residual_sums(moments, fits, cfg)
    scores = [
        f"CASE WHEN {t.attribute} = '{t.level}' THEN u_{t.period} ELSE 0D END AS {t.column}"
        if t.attribute
        else f"u_{t.period} AS {t.column}"
        for t in terms
    ]
    return scored.selectExpr("depvar", "id", *scores)


def _residual_sums(moments: DataFrame, fits: list[Fit], cfg: PanelConfig) -> DataFrame:
    """The moments with u_p, the sum of a firm's residuals in each dummy period."""
    spark = moments.sparkSession
    effects = [(f.depvar, *profile, c) for f in fits for profile, c in f.effects.items()]
    keys = ["depvar", "size", "foreign", "ownership"]
    # At most models x attribute profiles rows, hence a broadcast.
    slopes = spark.createDataFrame(
        effects, "depvar string, size string, foreign string, ownership string, c array<double>"
    )
    residual_sums = {}
    for p in dummies(cfg):
        fitted = [f"g_{min(p, q)}{max(p, q)} * c[{q - 1}]" for q in dummies(cfg)]
        residual_sums[f"u_{p}"] = F.expr(" - ".join([f"w_{p}", *fitted]))
    return moments.join(F.broadcast(slopes), keys).withColumns(residual_sums)
