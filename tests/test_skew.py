import dataclasses

from firmlens import PanelConfig, PanelStudy
from firmlens.operators.skew import attach_by_key
from helpers import statements


def test_hot_keys_are_split_and_rows_stay_whole(spark):
    rows = spark.range(0, 3000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN id % 4 ELSE id END AS k", "id AS v")
    per_key = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 10 AS tag")
    for hot_keys in (1000, 2, 1):
        joined = attach_by_key(rows, per_key, ["k"], "n", 100, hot_keys)
        got = sorted((r.k, r.v, r.tag) for r in joined.collect())
        assert got == sorted((r.k, r.v, r.k * 10) for r in rows.collect())


def test_hot_keys_are_joined_in_several_tasks(spark):
    rows = spark.range(0, 3000, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "id AS v")
    per_key = rows.groupBy("k").count().selectExpr("k", "count AS n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = attach_by_key(rows, per_key, ["k"], "n", hot_rows=100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        tasks = joined.where("k = 1").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert len(tasks) > 1 and sum(t["count"] for t in tasks) == 1001


def test_study_is_the_same_with_split_firms(spark):
    rows = [{"mb": 1 + (i % 3 > 0) * i, "year": 2018 + i % 6, "AOP1001": 9e6 + i * 1e4} for i in range(90)]
    source = statements(spark, *rows).repartition(6)
    plain = PanelStudy(source, PanelConfig())
    split = PanelStudy(source, dataclasses.replace(PanelConfig(), hot_rows=4))
    for report in ("panel_merged", "within_transform"):
        a, b = (sorted(map(repr, getattr(s, report)().collect())) for s in (plain, split))
        assert a == b and a
