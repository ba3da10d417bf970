"""Every registered query against its SQL counterpart, and the shape of key plans."""

import glob
import os
import re

import pytest

from firmlens import PanelStudy

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")

QUERIES = contract.queries()
ORACLE = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, connection, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(columns, cursor.fetchall())


def test_every_query_has_sql():
    # The training-data queries, where they are there, have tests of their own.
    own = {n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)}
    assert own <= set(ORACLE) <= set(QUERIES)
    assert len(own) == 36


def test_entry(spark):
    assert contract.entry(spark).count() == 7


@pytest.mark.parametrize("name", ["panel_merged", "within_transform", "firm_attributes", "regression_sample"])
def test_no_cross_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_firm_level_work_is_one_scan_and_one_exchange(spark, stand_in, tmp_path):
    """Attributes, profiles and moments of a written source come from one grouped pass."""
    from firmlens.config import STAND_IN
    from firmlens.operators.profile import firm_codes, firm_moments, firm_profiles, firm_table
    from firmlens.sources import read_statements, release

    path = str(tmp_path / "source")
    stand_in.write.parquet(path)
    study = PanelStudy(read_statements(spark, path), STAND_IN)
    plan = study.firm_table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Expand" not in plan
    written = study.firm_rows
    for df in (firm_codes(written), firm_profiles(written, STAND_IN), firm_moments(written, STAND_IN)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1 and path not in plan
    # What a reader of the unwritten table doesn't ask for is not computed.
    plan = firm_codes(firm_table(study.source, STAND_IN))._jdf.queryExecution().executedPlan().toString()
    assert "AOP1043" not in plan.split("FileScan")[1]
    release(written)
