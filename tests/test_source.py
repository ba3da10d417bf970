import pytest
from pyspark.sql import functions as F

from firmlens.sources import materialize, read_statements, source_profile, typed_statements, write_csv
from helpers import DEFAULTS, SCHEMA, statements


def test_missing_columns_are_listed(spark):
    with pytest.raises(ValueError, match="name, AOP1001"):
        typed_statements(spark.range(1).selectExpr("id AS mb", "2018 AS year"))


def test_text_cells_that_are_no_numbers_become_null(spark, tmp_path):
    header = ",".join(f.name for f in SCHEMA)
    good = "7,2019,Ada," + ",".join("12.5" for _ in range(10))
    bad = "8.0,2020,Bea,n/a," + ",".join("1" for _ in range(9))
    (tmp_path / "s.csv").write_text(f"{header}\n{good}\n{bad}\n")
    df = read_statements(spark, str(tmp_path / "s.csv"), "csv")
    assert df.schema == SCHEMA
    rows = {r.mb: r for r in df.collect()}
    assert rows[7].AOP1001 == 12.5
    assert rows[8].AOP1001 is None and rows[8].AOP1025 == 1.0 and rows[8].year == 2020


def test_nan_becomes_null(spark):
    row = statements(spark, {"AOP59": float("nan")}).first()
    assert row.AOP59 is None and row.AOP1001 == DEFAULTS["AOP1001"]


def test_profile(spark):
    row = source_profile(statements(spark, {"year": 2013}, {"year": 2023}, {"year": None})).first()
    assert (row.n_rows, row.n_columns, row.min_year, row.max_year) == (3, 13, 2013, 2023)
    assert row.has_key_columns
    assert not source_profile(spark.range(2)).first().has_key_columns


def test_parquet_scan_prunes_and_pushes_down(spark, tmp_path):
    from firmlens import PanelConfig
    from firmlens.operators.rows import panel_metrics

    path = str(tmp_path / "wide")
    statements(spark, {}, {"mb": 2}).withColumn("AOP4711", F.lit(1.0)).write.parquet(path)
    plan = panel_metrics(read_statements(spark, path), PanelConfig())._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan") :]
    assert "AOP4711" not in scan and "AOP9005" not in scan
    assert "GreaterThan(year,2017)" in scan and "LessThan(year,2024)" in scan


def test_year_folders_are_pruned(spark, tmp_path):
    from firmlens import PanelConfig
    from firmlens.operators.profile import firm_codes, firm_table

    path = str(tmp_path / "by_year")
    statements(spark, {"year": 2013}, {"year": 2018}).write.partitionBy("year").parquet(path)
    plan = firm_codes(firm_table(read_statements(spark, path), PanelConfig()))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.25), ("b", 2, None)], "Variable string, Obs bigint, R2 double")
    write_csv(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "Variable,Obs,R2"
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_materialize_reads_back_a_table(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    back = materialize(df, "test")
    assert sorted(back.collect()) == sorted(df.collect())
    assert "FileScan parquet" in back._jdf.queryExecution().toString()
