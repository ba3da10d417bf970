"""SQL statements of the same reports for an independent engine.

Each statement is a chain of CTEs over the given tables. The models follow the
textbook route here (row-level demeaning and a sweep of the cross-product matrix),
not the moment formulas of the Spark plan.
"""

from __future__ import annotations

from functools import partial

from firmlens.config import (
    FOREIGN_LEVELS,
    OWNERSHIP_LEVELS,
    SIZE_LEVELS,
    STAND_IN,
    PanelConfig,
)

_STAND_IN_CTES = {
    "li": """
  SELECT o_custkey AS mb, CAST(year(o_orderdate) AS INT) AS yr,
         CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS ep,
         CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_extendedprice) AS BIGINT) END) AS DOUBLE) AS ep_n,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice) AS BIGINT) END) AS DOUBLE) AS ep_r,
         CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(floor(l_extendedprice) AS BIGINT) END) AS DOUBLE) AS ep_a,
         CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "od": """
  SELECT o_custkey AS mb, CAST(year(o_orderdate) AS INT) AS yr,
         CAST(SUM(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) AS tp
  FROM orders GROUP BY 1, 2""",
    "p": """
  SELECT li.*, od.tp, c_name, li.mb % 60 = 2 AS is_micro, li.mb % 60 = 32 AS is_small
  FROM li JOIN od ON li.mb = od.mb AND li.yr = od.yr JOIN customer ON c_custkey = li.mb""",
    "panel": """
  SELECT mb, yr AS year,
    CASE WHEN (mb + yr) % 17 = 0 THEN NULL
         WHEN mb % 40 = 0 AND yr >= 1999 THEN concat(c_name, ' U STEČAJU')
         WHEN mb % 40 = 1 AND yr >= 1999 THEN concat(c_name, ' U LIKVIDACIJI')
         WHEN (mb + yr) % 3 = 0 THEN upper(c_name) ELSE c_name END AS name,
    CASE WHEN is_micro THEN floor(ep / 100) WHEN is_small THEN ep
         WHEN (mb + yr) % 29 = 0 THEN NULL WHEN (mb + yr) % 31 = 0 THEN 0.0E0 ELSE ep * 10 END AS AOP1001,
    CASE WHEN is_micro THEN floor(ep_n / 500) WHEN is_small THEN floor(ep_n / 5)
         WHEN mb % 50 = 7 THEN ep_n * 20 ELSE ep_n * 2 END AS AOP1025,
    CASE WHEN is_micro THEN floor(ep_r / 500) WHEN is_small THEN floor(ep_r / 5) ELSE ep_r * 2 END AS AOP1026,
    CASE WHEN yr >= 1998 OR mb % 7 < 3 THEN ep * 12 WHEN mb % 3 = 0 THEN 0.0E0 WHEN mb % 3 = 1 THEN 1.0E0 END AS AOP1043,
    CASE WHEN is_micro THEN floor(ep_a / 1000) WHEN is_small THEN floor(ep_a / 10)
         WHEN mb % 50 = 8 THEN ep_a * 20 ELSE ep_a END AS AOP1055,
    CASE WHEN is_micro THEN floor(ep_r / 1000) WHEN is_small THEN floor(ep_r / 10) ELSE ep_r END AS AOP1064,
    CASE WHEN is_micro THEN floor(tp / 100) WHEN is_small THEN floor(tp / 3)
         WHEN yr >= 1998 OR mb % 7 > 3 THEN tp * 5 WHEN mb % 2 = 0 THEN 0.0E0 END AS AOP59,
    CASE WHEN is_micro THEN 5.0E0 WHEN is_small THEN 30.0E0 WHEN (mb + yr) % 23 = 0 THEN NULL ELSE qty END AS AOP9005,
    CASE WHEN mb % 5 = 0 THEN NULL WHEN mb % 97 = 1 THEN 1.0E0 WHEN mb % 11 = 2 THEN 3.0E0
         WHEN mb % 11 = 3 THEN 4.0E0 WHEN mb % 11 = 4 THEN 5.0E0 ELSE 2.0E0 END AS AOP9002,
    CASE WHEN mb % 3 = 0 THEN NULL WHEN mb % 4 = 1 THEN 51.0E0 ELSE 0.0E0 END AS AOP9003
  FROM p""",
}


def _quoted(value) -> str:
    return f"'{value}'" if isinstance(value, str) else str(value)


def _label(code: str, levels) -> str:
    whens = " ".join(f"WHEN {_quoted(v)} THEN '{text}'" for v, text in levels)
    return f"CASE {code} {whens} END"


def _ordinal(label: str, levels) -> str:
    return _label_ordinal(label, [text for _, text in levels])


def _label_ordinal(label: str, texts) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(texts))
    return f"CASE {label} {whens} END"


def _half_even(expression: str, digits: int) -> str:
    return f"CAST(round_even(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def _significant(expression: str, digits: int = 6) -> str:
    exponent = f"CAST(floor(log10(abs({expression}))) AS INT)"
    mantissa = f"round_even(CAST({expression} / pow(10.0E0, {exponent}) AS DECIMAL(38,10)), {digits - 1})"
    return (
        f"CASE WHEN {expression} = 0 THEN 0.0E0 "
        f"ELSE CAST(concat({mantissa}, 'e', {exponent}) AS DOUBLE) END"
    )


def _number_text(expression: str) -> str:
    rounded = f"CAST(round_even(CAST({expression} AS DECIMAL(38,8)), 1) AS VARCHAR)"
    return f"regexp_replace({rounded}, '\\.0$', '')"


def _votes(cfg: PanelConfig, band: int) -> str:
    def inside(column: str, limits) -> str:
        parts = []
        if band > 0:
            parts.append(f"{column} > {limits[band - 1]}")
        if band < 3:
            parts.append(f"{column} <= {limits[band]}")
        return f"CAST({' AND '.join(parts)} AS INT)"

    employees = [f"{float(x)}E0" for x in cfg.employee_limits]
    revenue = [f"{x * cfg.eur}E0" for x in cfg.revenue_limits_eur]
    assets = [f"{x * cfg.eur}E0" for x in cfg.asset_limits_eur]
    return " + ".join(
        [inside("AOP9005", employees), inside("AOP1001", revenue), inside("AOP59", assets)]
    )


def _period(cfg: PanelConfig, year: str, result) -> str:
    whens = " ".join(
        f"WHEN {year} BETWEEN {first} AND {last} THEN {_quoted(result(i, label))}"
        for i, (label, first, last) in enumerate(cfg.periods, start=1)
    )
    return f"CASE {whens} END"


def _panel_ctes(cfg: PanelConfig) -> dict[str, str]:
    liquidation = " OR ".join(f"contains(name, '{t}')" for t in cfg.liquidation_pattern.split("|"))
    return {
        "frows": f"""
  SELECT mb, year, name, AOP9005, AOP1001, AOP59,
    CASE WHEN AOP9005 IS NULL OR AOP1001 IS NULL OR AOP59 IS NULL THEN {cfg.default_size}
         WHEN {_votes(cfg, 0)} >= 2 THEN 1 WHEN {_votes(cfg, 1)} >= 2 THEN 2
         WHEN {_votes(cfg, 2)} >= 2 THEN 3 WHEN {_votes(cfg, 3)} >= 2 THEN 4 ELSE {cfg.default_size} END AS size,
    AOP9003 IS NOT NULL AND AOP9003 > 0 AS is_foreign,
    CAST(coalesce(AOP9002, {cfg.default_ownership}) AS INT) AS ownership,
    name IS NOT NULL AND ({liquidation}) AS liquidation
  FROM panel WHERE year > {cfg.year_after} AND year < {cfg.year_before}""",
        "firms": f"""
  SELECT mb AS id, max(size) AS size, max(CAST(is_foreign AS INT)) AS is_foreign,
         max(ownership) AS ownership, bool_or(liquidation) AS liquidation
  FROM frows WHERE mb <> {cfg.excluded_id} GROUP BY mb""",
        "metrics0": f"""
  SELECT mb AS id, year, AOP1001 AS operating_revenue, AOP1043 AS total_revenue,
    AOP1025 AS operating_income, AOP1026 AS operating_loss, AOP1055 AS net_income,
    AOP1064 AS net_loss, AOP59 AS assets,
    coalesce(AOP1025, 0.0E0) - coalesce(AOP1026, 0.0E0) AS operating_result,
    coalesce(AOP1055, 0.0E0) - coalesce(AOP1064, 0.0E0) AS net_result
  FROM panel WHERE year > {cfg.year_after} AND year < {cfg.year_before}""",
        "metrics": f"""
  SELECT *, CASE WHEN operating_revenue <> 0 THEN operating_result / operating_revenue END AS operating_margin,
    CASE WHEN operating_revenue <> 0 THEN net_result / operating_revenue END AS net_margin,
    CASE WHEN operating_revenue > 0 THEN ln(operating_revenue) END AS log_operating_revenue,
    CASE WHEN total_revenue > 0 THEN ln(total_revenue) END AS log_total_revenue,
    CAST({_period(cfg, "year", lambda i, _: i)} AS INT) AS covid_period
  FROM metrics0""",
        "merged": f"""
  SELECT m.* EXCLUDE (covid_period),
    m.operating_revenue / 1000 AS operating_revenue_mil, m.total_revenue / 1000 AS total_revenue_mil,
    m.assets / 1000 AS assets_mil, m.operating_margin * 100 AS operating_margin_pct,
    m.net_margin * 100 AS net_margin_pct,
    {_period(cfg, "m.year", lambda _, label: label)} AS covid_period,
    {_label("f.size", SIZE_LEVELS)} AS size, {_label("f.is_foreign", FOREIGN_LEVELS)} AS "foreign",
    {_label("f.ownership", OWNERSHIP_LEVELS)} AS ownership
  FROM metrics m LEFT JOIN firms f ON m.id = f.id
  WHERE NOT f.liquidation AND f.size > {cfg.size_above} AND f.ownership <> {cfg.excluded_ownership}
    AND abs(m.operating_margin) < {cfg.margin_bound} AND abs(m.net_margin) < {cfg.margin_bound}""",
        "per_firm": """
  SELECT id, min(size) AS size, min("foreign") AS "foreign", min(ownership) AS ownership,
         count(DISTINCT year) AS n_years FROM merged GROUP BY id""",
    }

# Slopes as (period, attribute column, level): the twelve of the model, in order.
_TERMS = [
    (period, attribute, level)
    for attribute, levels in (
        (None, (None,)),
        ("size", ("Large",)),
        ("foreign", ("1",)),
        ("ownership", ("Cooperative", "Mixed", "Government")),
    )
    for level in levels
    for period in ("Covid", "Post")
]
_K = len(_TERMS)


def _term_name(period, attribute, level) -> str:
    suffix = f":{attribute.capitalize()}{level}" if attribute else ""
    return f"Covid_period{period}{suffix}"


def _term_column(period, attribute, level) -> str:
    return f"{period}_{attribute}_{level}".lower() if attribute else period.lower()


def _dummy(period, attribute, level) -> str:
    condition = f"covid_period = '{period}'"
    if attribute:
        condition += f" AND \"{attribute}\" = '{level}'"
    return f"CASE WHEN {condition} THEN 1.0E0 ELSE 0.0E0 END"


def _sample_sql(cfg: PanelConfig) -> str:
    parts = [
        f"SELECT '{depvar}' AS depvar, {column} AS y, id, year, covid_period, size, \"foreign\", ownership "
        f"FROM merged WHERE {column} IS NOT NULL" + (f" AND {column} > 0" if positive else "")
        for depvar, column, positive in cfg.dependent_variables
    ]
    return "\n  UNION ALL ".join(parts)


def _within_sql() -> str:
    columns = ", ".join(
        f"x{i} - avg(x{i}) OVER firm AS x{i}" for i in range(_K)
    )
    dummies = ", ".join(f"{_dummy(*t)} AS x{i}" for i, t in enumerate(_TERMS))
    return f"""
  SELECT depvar, id, year, y - avg(y) OVER firm AS x{_K}, {columns}
  FROM (SELECT depvar, id, year, y, {dummies} FROM sample)
  WINDOW firm AS (PARTITION BY depvar, id)"""


def _cells_sql(relation: str, product: str, pairs) -> str:
    """Long (depvar, i, j, v) table of column products summed by model."""
    sums = ", ".join(f"sum({product.format(i=i, j=j)}) AS c_{i}_{j}" for i, j in pairs)
    cells = "\n    UNION ALL ".join(
        f"SELECT depvar, {i} AS i, {j} AS j, c_{i}_{j} AS v FROM s" for i, j in pairs
    )
    return f"""
  SELECT * FROM (WITH s AS MATERIALIZED (SELECT depvar, {sums} FROM {relation} GROUP BY depvar)
    {cells})"""


_UPPER = [(i, j) for i in range(_K + 1) for j in range(i, _K + 1)]

_MODEL_CTES = {
    "demeaned": _within_sql(),
    "upper_cells": _cells_sql("demeaned", "x{i} * x{j}", _UPPER),
    "sweep0": """
  SELECT depvar, i, j, v FROM upper_cells
  UNION ALL SELECT depvar, j, i, v FROM upper_cells WHERE i <> j""",
    **{
        f"sweep{p + 1}": f"""
  SELECT s.depvar, s.i, s.j,
    CASE WHEN s.i = {p} AND s.j = {p} THEN -1.0E0 / d.v
         WHEN s.i = {p} OR s.j = {p} THEN s.v / d.v
         ELSE s.v - c.v * r.v / d.v END AS v
  FROM sweep{p} s
  JOIN sweep{p} d ON d.depvar = s.depvar AND d.i = {p} AND d.j = {p}
  JOIN sweep{p} c ON c.depvar = s.depvar AND c.i = s.i AND c.j = {p}
  JOIN sweep{p} r ON r.depvar = s.depvar AND r.i = {p} AND r.j = s.j"""
        for p in range(_K)
    },
    "beta": f"SELECT depvar, i, v AS b FROM sweep{_K} WHERE j = {_K} AND i < {_K}",
    "bread": f"SELECT depvar, i, j, -v AS v FROM sweep{_K} WHERE i < {_K} AND j < {_K}",
    "counts": """
  SELECT depvar, count(*) AS obs, count(DISTINCT id) AS firms FROM sample GROUP BY depvar""",
    "fits": f"""
  SELECT c.depvar, c.obs, c.firms, t.v AS tss, r.v AS rss, c.obs - c.firms - {_K} AS df,
         1.0E0 - r.v / t.v AS r2
  FROM counts c JOIN sweep0 t ON t.depvar = c.depvar AND t.i = {_K} AND t.j = {_K}
  JOIN sweep{_K} r ON r.depvar = c.depvar AND r.i = {_K} AND r.j = {_K}""",
    "wide_beta": "SELECT depvar, "
    + ", ".join(f"max(CASE WHEN i = {i} THEN b END) AS b{i}" for i in range(_K))
    + " FROM beta GROUP BY depvar",
    "residuals": f"""
  SELECT d.*, d.x{_K} - ({" + ".join(f"d.x{i} * w.b{i}" for i in range(_K))}) AS e
  FROM demeaned d JOIN wide_beta w ON w.depvar = d.depvar""",
    "scores": "SELECT depvar, id, "
    + ", ".join(f"sum(x{i} * e) AS s{i}" for i in range(_K))
    + " FROM residuals GROUP BY depvar, id",
    "meat": _cells_sql("scores", "s{i} * s{j}", [(i, j) for i in range(_K) for j in range(_K)]),
    "half": """
  SELECT a.depvar, a.i, m.j, sum(a.v * m.v) AS v
  FROM bread a JOIN meat m ON m.depvar = a.depvar AND m.i = a.j GROUP BY 1, 2, 3""",
    "cov": f"""
  SELECT h.depvar, h.i, b.j,
         sum(h.v * b.v) * any_value(CAST(f.obs AS DOUBLE) / (f.obs - {_K})) AS v
  FROM half h JOIN bread b ON b.depvar = h.depvar AND b.i = h.j
  JOIN fits f ON f.depvar = h.depvar GROUP BY 1, 2, 3""",
}

_NAMES = "names(i, term) AS (VALUES " + ", ".join(
    f"({i}, '{_term_name(*t)}')" for i, t in enumerate(_TERMS)
) + ")"
_COLUMNS = "columns(i, col) AS (VALUES " + ", ".join(
    [f"({i}, '{_term_column(*t)}')" for i, t in enumerate(_TERMS)] + [f"({_K}, 'y')"]
) + ")"


# Two-sided Student-t tail by Simpson's rule: with t = sqrt(df) tan(a) the density is
# proportional to cos(a)^(df-1), and 12 / sqrt(df) beyond the start nothing is left.
_STEPS = 4000
_TAILS = f"""tails AS (
  SELECT depvar, term, 2 * exp(lgamma((df + 1) / 2.0E0) - lgamma(df / 2.0E0) - 0.5E0 * ln(pi()))
    * sum(CASE WHEN s IN (0, {_STEPS}) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
          * exp((df - 1) * ln(cos(a0 + s * h)))) * h / 3 AS p
  FROM (SELECT *, (least(pi() / 2, a0 + 12 / sqrt(df)) - a0) / {_STEPS} AS h
        FROM (SELECT b.depvar, n.term, f.df, atan(abs(b.b / sqrt(c.v)) / sqrt(f.df)) AS a0
              FROM beta b JOIN cov c ON c.depvar = b.depvar AND c.i = b.i AND c.j = b.i
              JOIN fits f ON f.depvar = b.depvar JOIN names n ON n.i = b.i)),
       generate_series(0, {_STEPS}) AS steps(s)
  GROUP BY depvar, term, df, a0, h)"""


def _chained(ctes: dict[str, str], final: str, upto: str, extra: str = "") -> str:
    """The CTE chain up to and including `upto`, then the final query."""
    chain = []
    for name, text in ctes.items():
        chain.append(f"{name} AS MATERIALIZED ({text})")
        if name == upto:
            break
    if extra:
        chain.append(extra)
    return "WITH " + ",\n".join(chain) + "\n" + final


def _share(n: str, total: str) -> str:
    return _half_even(f"{n} * 100.0E0 / {total}", 1)


def _aliased_sql() -> str:
    periods = ("Covid", "Post")
    attributes = (
        ("Size", [t for _, t in SIZE_LEVELS[1:]]),
        ("Foreign", [t for _, t in FOREIGN_LEVELS[1:]]),
        ("Ownership", [t for _, t in OWNERSHIP_LEVELS[1:]]),
    )
    columns = {f"Covid_period{p}": _dummy(p, None, None) for p in periods}
    for attribute, labels in attributes:
        for label in labels:
            is_level = f"\"{attribute.lower()}\" = '{label}'"
            columns[f"{attribute}{label}"] = f"CASE WHEN {is_level} THEN 1.0E0 ELSE 0.0E0 END"
            for p in periods:
                columns[f"Covid_period{p}:{attribute}{label}"] = _dummy(p, attribute.lower(), label)
    variation = ", ".join(
        f"covar_pop(c{i}, c{i}) * count(*) AS c{i}" for i, _ in enumerate(columns)
    )
    values = ", ".join(f"{text} AS c{i}" for i, text in enumerate(columns.values()))
    totals = ", ".join(f"sum(c{i}) AS c{i}" for i, _ in enumerate(columns))
    rows = "\n  UNION ALL ".join(
        f"SELECT depvar, '{name}' AS term, c{i} AS v FROM totals" for i, name in enumerate(columns)
    )
    return f"""
, firm_variation AS MATERIALIZED (SELECT depvar, id, {variation}
  FROM (SELECT depvar, id, {values} FROM sample) GROUP BY depvar, id),
totals AS MATERIALIZED (SELECT depvar, {totals} FROM firm_variation GROUP BY depvar)
SELECT depvar, term, {_significant("v")} AS within_ss,
  CASE WHEN v > 0 THEN 'kept' ELSE 'no within variation' END AS status
FROM ({rows})"""


def repeated_source(where: str) -> dict[str, str]:
    """The CTEs of the stand-in panel, with the rows that `where` names twice."""
    ctes = {("panel_once" if k == "panel" else k): text for k, text in _STAND_IN_CTES.items()}
    twice = f"SELECT * FROM panel_once UNION ALL SELECT * FROM panel_once WHERE {where}"
    return ctes | {"panel": twice}


def statements(cfg: PanelConfig = STAND_IN, source: dict[str, str] | None = None) -> dict[str, str]:
    """SQL of every report with a counterpart.

    `source` names the CTEs that end in `panel`; by default the stand-in panel.
    """
    ctes = {**(source or _STAND_IN_CTES), **_panel_ctes(cfg)}
    ctes |= {"sample": _sample_sql(cfg), **_MODEL_CTES}
    _statement = partial(_chained, ctes)
    size_names = "CASE size WHEN 1 THEN 'Micro' WHEN 2 THEN 'Small' WHEN 3 THEN 'Medium' WHEN 4 THEN 'Large' END"
    metric_columns = """id, year, operating_revenue, total_revenue, operating_income, operating_loss,
  net_income, net_loss, assets, operating_result, net_result, operating_margin, net_margin,
  round(log_operating_revenue, 6) AS log_operating_revenue, round(log_total_revenue, 6) AS log_total_revenue,
  covid_period"""

    def level_counts(key: str, label: str) -> str:
        return f"""
SELECT {label}, n, {_share("n", "total")} AS percentage
FROM (SELECT {key}, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM per_firm GROUP BY {key})"""

    def size_counts(where: str, total: str) -> str:
        return f"""
SELECT size, {size_names} AS size_label, n, {_share("n", "total")} AS percentage, total AS {total}
FROM (SELECT size, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM firms {where} GROUP BY size)"""

    cells = """
, cells AS (SELECT year, size, avg(assets_mil) AS mean, median(assets_mil) AS mid, count(*) AS n
  FROM merged GROUP BY year, size)"""
    cell_text = f"concat(coalesce({_number_text('mean')}, 'NaN'), ' (', coalesce({_number_text('mid')}, 'NA'), ') n=', n)"

    def size_cell(size: str) -> str:
        return f"coalesce(max(CASE WHEN size = '{size}' THEN {cell_text} END), 'N/A') AS \"{size}\""

    size_stats = ", ".join(
        f"{_half_even(f'avg({c})', 2)} AS mean_{name}, {_half_even(f'median({c})', 2)} AS median_{name}"
        for name, c in (
            ("revenue", "operating_revenue_mil"),
            ("tot_revenue", "total_revenue_mil"),
            ("assets", "assets_mil"),
            ("op_margin", "operating_margin_pct"),
        )
    )
    first, last = cfg.ownership_asset_years
    dummies = ", ".join(f"{_dummy(*t)} AS {_term_column(*t)}" for t in _TERMS)
    within = ", ".join(f"round(x{i}, 6) + 0.0E0 AS {_term_column(*t)}" for i, t in enumerate(_TERMS))
    scores = ", ".join(
        f"round(s{i}, 3) + 0.0E0 AS {_term_column(*t)}" for i, t in enumerate(_TERMS)
    )
    unit = """CASE WHEN right(depvar, 4) = '_mil' THEN 'RSD millions'
       WHEN right(depvar, 4) = '_pct' THEN 'percentage points' END"""

    return {
        "panel_source": _statement("SELECT * FROM panel", "panel"),
        "source_profile": _statement(
            """SELECT 'statements' AS source_table, count(*) AS n_rows,
       max(len(json_keys(to_json(p)))) AS n_columns,
       bool_and(list_has_all(json_keys(to_json(p)), ['mb', 'year', 'name'])) AS has_key_columns,
       min(year) AS min_year, max(year) AS max_year FROM panel p
     UNION ALL SELECT 'orders', count(*), max(len(json_keys(to_json(o)))),
       bool_and(list_has_all(json_keys(to_json(o)), ['mb', 'year', 'name'])), NULL, NULL
     FROM orders o""",
            "panel",
        ),
        "liquidation_flags": _statement(
            "SELECT mb AS id, year, name, liquidation FROM frows", "frows"
        ),
        "size_class_rows": _statement(
            """SELECT mb AS id, year, AOP9005 AS employees, AOP1001 AS operating_revenue,
       AOP59 AS assets, CAST(size AS INT) AS size FROM frows""",
            "frows",
        ),
        "firm_attributes": _statement(
            f"""SELECT f.id, CAST(f.size AS INT) AS size, f.is_foreign AS "foreign", f.ownership, f.liquidation, n.name
FROM firms f LEFT JOIN (
  SELECT mb, name, row_number() OVER (PARTITION BY mb ORDER BY count(*) DESC, name) AS rn
  FROM frows WHERE name IS NOT NULL GROUP BY mb, name) n ON n.mb = f.id AND n.rn = 1""",
            "firms",
        ),
        "firm_modal_name": _statement(
            """SELECT f.id, n.name, coalesce(n.uses, 0) AS name_uses
FROM firms f LEFT JOIN (
  SELECT mb, name, count(*) AS uses, row_number() OVER (PARTITION BY mb ORDER BY count(*) DESC, name) AS rn
  FROM frows WHERE name IS NOT NULL GROUP BY mb, name) n ON n.mb = f.id AND n.rn = 1""",
            "firms",
        ),
        "size_distribution": _statement(
            size_counts("", "total_firms")
            + "\nUNION ALL SELECT NULL, NULL, 0, NULL, 0 FROM firms HAVING count(*) = 0",
            "firms",
        ),
        "liquidation_size_distribution": _statement(
            size_counts("WHERE liquidation", "liquidated_firms")
            + """
UNION ALL SELECT NULL, NULL, 0, NULL, 0 FROM firms HAVING coalesce(count_if(liquidation), 0) = 0""",
            "firms",
        ),
        "repeated_keys": _statement(
            "SELECT id, year, count(*) AS n FROM merged GROUP BY id, year HAVING count(*) > 1",
            "merged",
        ),
        "covid_period": _statement(
            f"SELECT id, year, covid_period, {_period(cfg, 'year', lambda _, label: label)} AS period_label FROM metrics",
            "metrics",
        ),
        "panel_metrics": _statement(f"SELECT {metric_columns} FROM metrics", "metrics"),
        "panel_merged": _statement(
            f"""SELECT {metric_columns}, operating_revenue_mil, total_revenue_mil, assets_mil,
  operating_margin_pct, net_margin_pct, size, "foreign", ownership FROM merged""",
            "merged",
        ),
        "quality_report": _statement(
            "SELECT count(*) AS observations, count(DISTINCT id) AS firms FROM merged", "merged"
        ),
        "years_covered": _statement(
            "SELECT string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS years FROM (SELECT DISTINCT year FROM metrics)",
            "metrics",
        ),
        "firm_size_distribution": _statement(
            level_counts("size", "size, size AS size_label"), "per_firm"
        ),
        "ownership_distribution": _statement(level_counts("ownership", "ownership"), "per_firm"),
        "foreign_distribution": _statement(
            level_counts(
                '"foreign"',
                "CASE WHEN \"foreign\" = '1' THEN 'Foreign' ELSE 'Domestic' END AS foreign_label",
            ),
            "per_firm",
        ),
        "panel_balance": _statement(
            "SELECT CAST(n_years AS INT) AS n_years, count(*) AS n FROM per_firm GROUP BY n_years",
            "per_firm",
        ),
        "balanced_firms": _statement(
            f"SELECT count(*) AS balanced_firms FROM per_firm WHERE n_years = {cfg.n_years} HAVING count(*) > 0",
            "per_firm",
        ),
        "panel_key_check": _statement(
            """SELECT CAST(sum(n) AS BIGINT) AS observations, count(*) AS distinct_keys,
  CAST(sum(n) - count(*) AS BIGINT) AS surplus_rows
FROM (SELECT id, year, count(*) AS n FROM merged GROUP BY id, year)""",
            "merged",
        ),
        "size_stats": _statement(
            f"SELECT size, count(DISTINCT id) AS n_firms, count(*) AS n_obs, {size_stats} FROM merged GROUP BY size",
            "merged",
        ),
        "assets_long": _statement(
            f"""{cells}
SELECT year, size, {_half_even("mean", 1)} AS mean_assets, {_half_even("mid", 1)} AS median_assets,
  n AS observations, {cell_text} AS assets FROM cells""",
            "merged",
        ),
        "assets_wide": _statement(
            f"{cells}\nSELECT year, {size_cell('Medium')}, {size_cell('Large')} FROM cells GROUP BY year",
            "merged",
        ),
        "assets_by_ownership": _statement(
            f"""SELECT ownership, {_half_even("avg(assets_mil)", 1)} AS mean_assets,
  {_half_even("median(assets_mil)", 1)} AS median_assets, count(*) AS observations
FROM merged WHERE year BETWEEN {first} AND {last} GROUP BY ownership""",
            "merged",
        ),
        "regression_sample": _statement(
            'SELECT depvar, round(y, 6) + 0.0E0 AS y, id, year, covid_period, size, "foreign", ownership FROM sample',
            "sample",
        ),
        "design_matrix": _statement(f"SELECT id, year, {dummies} FROM merged", "merged"),
        "within_transform": _statement(
            f"SELECT depvar, id, year, round(x{_K}, 5) + 0.0E0 AS y, {within} FROM demeaned",
            "demeaned",
        ),
        "within_moments": _statement(
            f"""SELECT depvar, a.col AS a, b.col AS b, {_significant("v")} AS value
FROM upper_cells JOIN columns a ON a.i = upper_cells.i JOIN columns b ON b.i = upper_cells.j""",
            "upper_cells",
            _COLUMNS,
        ),
        "aliased_terms": _statement(_aliased_sql(), "sample"),
        "fe_summary": _statement(
            f"""SELECT depvar, {unit} AS unit, obs, firms, {_half_even("r2", 4)} AS r2,
  {_half_even("1.0E0 - (1.0E0 - r2) * (obs - 1) / df", 4)} AS adj_r2,
  {_half_even(f"(r2 / {_K}) / ((1.0E0 - r2) / df)", 2)} AS f_stat FROM fits""",
            "fits",
        ),
        "firm_scores": _statement(f"SELECT depvar, id, {scores} FROM scores", "scores"),
        "fe_cluster_cov": _statement(
            f"""SELECT depvar, a.term AS term_a, b.term AS term_b, {_significant("v", 5)} AS cov
FROM cov JOIN names a ON a.i = cov.i JOIN names b ON b.i = cov.j""",
            "cov",
            _NAMES,
        ),
        "fe_coefficients": _statement(
            f"""SELECT b.depvar, n.term, {_significant("b.b")} AS estimate,
  {_significant("sqrt(c.v)")} AS std_error, {_significant("b.b / sqrt(c.v)")} AS t_value
FROM beta b JOIN cov c ON c.depvar = b.depvar AND c.i = b.i AND c.j = b.i JOIN names n ON n.i = b.i""",
            "cov",
            _NAMES,
        ),
        "fe_coef_tests": _statement(
            f"""SELECT depvar, term, {_significant("p")} AS p_value,
  CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*'
       WHEN p <= 0.1 THEN '.' ELSE '' END AS stars
FROM tails""",
            "cov",
            f"{_NAMES}, {_TAILS}",
        ),
    }
