"""The default study on a table with a third of its rows in one firm, against SQL."""

import dataclasses

import pytest

from firmlens import PanelConfig, PanelStudy
from firmlens.functions.formats import round_significant
from firmlens.plans.oracle import statements
from firmlens.sources import read_statements

duckdb = pytest.importorskip("duckdb")

ROWS = 30_000


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed") / "statements")

    def amount(seed, low, width):
        return f"cast({low} + pmod(hash(id, {seed}), {width}) AS double)"

    def of_firm(seed, modulus):
        return f"pmod(hash(mb, {seed}), {modulus})"

    (
        spark.range(0, ROWS, 1, 6)
        .selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id div 12 END AS mb")
        .selectExpr(
            "mb",
            "cast(2017 + id % 8 AS int) AS year",
            f"CASE WHEN {of_firm(9, 30)} = 0 THEN concat('F', mb, ' U STEČAJU') "
            "WHEN id % 11 = 0 THEN NULL ELSE concat('F', mb % 50, '-', id % 2) END AS name",
            f"CASE WHEN id % 37 = 0 THEN 0D WHEN id % 41 = 0 THEN NULL ELSE {amount(1, 500000, 9000000)} END AS AOP1001",
            f"{amount(2, 0, 600000)} AS AOP1025",
            f"CASE WHEN id % 5 > 0 THEN {amount(3, 0, 500000)} END AS AOP1026",
            f"CASE WHEN id % 7 = 0 THEN 1D WHEN id % 13 > 0 THEN {amount(4, 1, 9000000)} END AS AOP1043",
            f"{amount(5, 0, 400000)} AS AOP1055",
            f"CASE WHEN id % 4 > 0 THEN {amount(6, 0, 300000)} END AS AOP1064",
            f"CASE WHEN id % 17 > 0 THEN {amount(7, 0, 8000000)} END AS AOP59",
            f"cast({of_firm(8, 700)} AS double) AS AOP9005",
            f"CASE WHEN {of_firm(10, 6)} > 0 THEN cast({of_firm(10, 6)} AS double) END AS AOP9002",
            f"CASE {of_firm(11, 4)} WHEN 0 THEN 51D WHEN 1 THEN 0D END AS AOP9003",
        )
        .write.parquet(folder)
    )
    return folder


@pytest.fixture(scope="module")
def study(spark, path):
    cfg = dataclasses.replace(PanelConfig(), hot_rows=500, duplicate_keys="allow")
    return PanelStudy(read_statements(spark, path), cfg).materialized()


SIGNIFICANT = {"fe_coefficients": ["estimate", "std_error", "t_value"], "within_moments": ["value"]}


@pytest.mark.parametrize(
    "name",
    [
        "firm_attributes",
        "size_distribution",
        "liquidation_size_distribution",
        "quality_report",
        "ownership_distribution",
        "foreign_distribution",
        "panel_balance",
        "panel_key_check",
        "size_stats",
        "assets_wide",
        "assets_by_ownership",
        "design_matrix",
        "within_moments",
        "fe_summary",
        "fe_coefficients",
    ],
)
def test_report(study, path, name):
    sql = statements(study.cfg, {"panel": f"SELECT * FROM '{path}/*.parquet'"})[name]
    cursor = duckdb.connect().execute(sql)
    columns = [d[0] for d in cursor.description]
    df = getattr(study, name)()
    df = df.withColumns({c: round_significant(c) for c in SIGNIFICANT.get(name, [])})
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, cursor.fetchall()))
    assert got


def test_the_panel_reads_written_firm_codes(spark, path):
    """The list of hot firms and the join read what one firm aggregation wrote."""
    study = PanelStudy(read_statements(spark, path), PanelConfig())
    plan = study.panel_merged()._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "firm_codes" in plan
    study.close()
