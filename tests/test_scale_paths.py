"""Paths that only show at scale or on inputs unlike the usual ones."""

import dataclasses
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens import PanelConfig, PanelStudy
from firmlens.functions.student_t import two_sided_p
from firmlens.operators import medians
from firmlens.operators.skew import attach_by_key
from firmlens.sources import materialize, read_statements, release, shared_folder, typed_statements, write_csv
from helpers import statements


def test_hot_key_of_equal_rows_meets_in_several_tasks(spark):
    rows = spark.range(0, 3000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id % 3 AS v")
    per_key = rows.groupBy("k").count().selectExpr("k", "count AS n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach_by_key(rows, per_key, ["k"], "n", hot_rows=100)
        tasks = joined.where("k = 1").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) > 1 and sum(t["count"] for t in tasks) == 1001


def test_a_window_of_a_hundred_years(spark):
    cfg = dataclasses.replace(PanelConfig(), year_after=1900, year_before=2001)
    rows = [{"mb": 1, "year": y} for y in range(1901, 2001)] + [{"mb": 2, "year": y} for y in (1901, 1975, 1975)]
    study = PanelStudy(statements(spark, *rows), cfg)
    assert {r.n_years: r.n for r in study.panel_balance().collect()} == {2: 1, 100: 1}
    assert study.balanced_firms().first().balanced_firms == 1
    assert study.panel_key_check().first().surplus_rows == 1


def test_medians_of_dense_values_rank_few_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = 1000 + rng.random(20_000) * 1e-6
    values[:5] = [1.0, 2.0, 1e9, 1001.0, 1010.0]
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, x double")
    plain, cells = medians._narrow, []

    def counted(rows, group, cell):
        if cell == medians._LINEAR_CELL:
            cells.append(rows.selectExpr(f"{cell} AS c").distinct().count())
        return plain(rows, group, cell)

    monkeypatch.setattr(medians, "_narrow", counted)
    assert medians.exact_medians(df, ["g"], ["x"]).first().x == np.median(values)
    assert len(cells) > 1 and max(cells) <= 4097


@pytest.mark.parametrize("kind", ["int", "bigint", "double"])
def test_both_year_bounds_reach_the_scan(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    frame = statements(spark, {"year": 2013}, {"year": 2018})
    frame.withColumn("year", F.col("year").cast(kind)).write.parquet(path)
    df = read_statements(spark, path, years=(2017, 2024))
    scan = df._jdf.queryExecution().toString()
    assert "GreaterThan(year,2017" in scan and "LessThan(year,2024" in scan
    assert dict(df.dtypes)["year"] == "int" and [r.year for r in df.collect()] == [2018]


def test_ids_and_years_from_text_and_fractions(spark):
    one = statements(spark, {}).drop("mb", "year")
    pairs = [("9007199254740992", "2018"), ("9007199254740993", "2018.0"), ("8.0", "2018.7"), ("8.5", "x")]
    raw = spark.createDataFrame(pairs, "mb string, year string").crossJoin(one)
    got = {(r.mb, r.year) for r in typed_statements(raw).collect()}
    assert got == {(9007199254740992, 2018), (9007199254740993, 2018), (8, None), (None, None)}


def test_closing_a_study_leaves_nothing_behind(spark, tmp_path):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [{"mb": m, "year": y} for m in range(1, 5) for y in range(2018, 2024)]
    with PanelStudy(statements(spark, *rows)).materialized() as study:
        assert study.size_stats().count() > 0
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) <= before
    with PanelStudy(statements(spark, *rows)) as study:
        reports = study.run(str(tmp_path / "summary"))
        assert all(r.count() >= 0 for r in reports.values())
    assert set(os.listdir(folder)) <= before


def test_release_leaves_other_frames_alone(spark):
    release(spark.range(1))
    table = materialize(spark.range(3), "t")
    release(table)
    release(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        table.collect()


def test_repeated_keys_are_refused_where_asked_for(spark):
    rows = [{"mb": m, "year": y} for m in range(1, 5) for y in range(2018, 2024)] + [{"mb": 1, "year": 2019}]
    source = statements(spark, *rows)
    assert PanelStudy(source, PanelConfig(duplicate_keys="allow")).fe_summary().count() > 0
    with pytest.raises(ValueError, match="1 rows beyond one"):
        PanelStudy(source).fe_summary()
    assert [tuple(r) for r in PanelStudy(source).repeated_keys().collect()] == [(1, 2019, 2)]


def test_no_liquidation_counts_zero(spark):
    study = PanelStudy(statements(spark, {}, {"mb": 2}))
    assert [tuple(r) for r in study.liquidation_size_distribution().collect()] == [(None, None, 0, None, 0)]
    empty = PanelStudy(statements(spark, {}).where("false"))
    assert [tuple(r) for r in empty.size_distribution().collect()] == [(None, None, 0, None, 0)]
    assert empty.liquidation_size_distribution().first().liquidated_firms == 0
    assert empty.fe_summary().count() == 0


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    plain = spark.sparkContext.master
    for master, folder, shared in [(plain, "/tmp/w", True), ("spark://host:7077", "/tmp/w", False),
                                   ("yarn", "file:/tmp/w", False), ("yarn", "hdfs://n/w", True)]:
        class Conf:
            def get(self, key, default=None):
                return default if key == "spark.checkpoint.dir" else folder

        class Context:
            def getCheckpointDir(self):
                return None

        Context.master = master
        session = type("S", (), {"conf": Conf(), "sparkContext": Context()})()
        if shared:
            assert shared_folder(session) == f"{folder}/_intermediate"
        else:
            with pytest.raises(ValueError, match="all executors share"):
                shared_folder(session)


@pytest.mark.parametrize("df", [1e5, 1e9, 1e11, 1e13, 1e15])
def test_p_tends_to_the_normal_tail(df):
    assert two_sided_p(1.959963984540054, df) == pytest.approx(0.05, abs=3e-6)


def test_missing_values_have_a_text_in_the_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "v string, f double")
    write_csv(df, str(tmp_path / "out"), null_text="NA")
    assert next((tmp_path / "out").glob("*.csv")).read_text().splitlines() == ["v,f", "a,NA"]


def test_source_profile_looks_at_the_table_as_it_came(spark):
    raw = statements(spark, {}, {}).selectExpr("*", "1 AS more")
    row = PanelStudy(typed_statements(raw), raw=raw).source_profile().first()
    assert (row.n_rows, row.n_columns, row.has_key_columns) == (2, 14, True)
    assert not PanelStudy(typed_statements(raw), raw=raw.drop("name")).source_profile().first().has_key_columns
