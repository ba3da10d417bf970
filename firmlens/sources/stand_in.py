"""The statement table built from orders, lineitem and customer.

A firm is a customer and a year is an order year. Measures are integer-valued
doubles, so every sum is exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared, so that building a plan needs no job that reads file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_returnflag string, l_quantity double, l_extendedprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_totalprice double",
    "customer": "c_custkey bigint, c_name string",
}


def stand_in_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(_firm_years(spark, sf_dir))


def _firm_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    # Items collapse to one row per order before the join, so the join is one to
    # one and neither a long order nor a busy customer makes a hot join key.
    items = (
        table("lineitem")
        .selectExpr("l_orderkey", "l_returnflag", "l_quantity", "floor(l_extendedprice) AS price")
        .groupBy("l_orderkey")
        .agg(
            F.expr("sum(price) AS ep"),
            F.expr("sum(CASE WHEN l_returnflag = 'N' THEN price END) AS ep_n"),
            F.expr("sum(CASE WHEN l_returnflag = 'R' THEN price END) AS ep_r"),
            F.expr("sum(CASE WHEN l_returnflag = 'A' THEN price END) AS ep_a"),
            F.expr("sum(cast(l_quantity AS bigint)) AS qty"),
        )
    )
    orders = table("orders").selectExpr(
        "o_orderkey",
        "o_custkey AS mb",
        "year(o_orderdate) AS year",
        "floor(o_totalprice) AS tp",
    )
    sums = ("ep", "ep_n", "ep_r", "ep_a", "qty", "tp")
    yearly = (
        orders.join(items, orders.o_orderkey == items.l_orderkey, "left")
        .groupBy("mb", "year")
        .agg(
            *[F.expr(f"cast(sum({c}) AS double) AS {c}") for c in sums],
            F.count("l_orderkey").alias("matched"),
        )
        .where("matched > 0")
    )
    customers = table("customer").selectExpr("c_custkey AS mb", "c_name")
    return yearly.join(customers, "mb")


def _statements(p: DataFrame) -> DataFrame:
    micro, small = "mb % 60 = 2", "mb % 60 = 32"
    return p.selectExpr(
        "mb",
        "year",
        """CASE WHEN (mb + year) % 17 = 0 THEN NULL
             WHEN mb % 40 = 0 AND year >= 1999 THEN concat(c_name, ' U STEČAJU')
             WHEN mb % 40 = 1 AND year >= 1999 THEN concat(c_name, ' U LIKVIDACIJI')
             WHEN (mb + year) % 3 = 0 THEN upper(c_name) ELSE c_name END AS name""",
        f"""CASE WHEN {micro} THEN cast(floor(ep / 100) AS double) WHEN {small} THEN ep
             WHEN (mb + year) % 29 = 0 THEN NULL WHEN (mb + year) % 31 = 0 THEN 0D
             ELSE ep * 10 END AS AOP1001""",
        f"""CASE WHEN {micro} THEN cast(floor(ep_n / 500) AS double)
             WHEN {small} THEN cast(floor(ep_n / 5) AS double)
             WHEN mb % 50 = 7 THEN ep_n * 20 ELSE ep_n * 2 END AS AOP1025""",
        f"""CASE WHEN {micro} THEN cast(floor(ep_r / 500) AS double)
             WHEN {small} THEN cast(floor(ep_r / 5) AS double) ELSE ep_r * 2 END AS AOP1026""",
        """CASE WHEN year >= 1998 OR mb % 7 < 3 THEN ep * 12 WHEN mb % 3 = 0 THEN 0D
             WHEN mb % 3 = 1 THEN 1D END AS AOP1043""",
        f"""CASE WHEN {micro} THEN cast(floor(ep_a / 1000) AS double)
             WHEN {small} THEN cast(floor(ep_a / 10) AS double)
             WHEN mb % 50 = 8 THEN ep_a * 20 ELSE ep_a END AS AOP1055""",
        f"""CASE WHEN {micro} THEN cast(floor(ep_r / 1000) AS double)
             WHEN {small} THEN cast(floor(ep_r / 10) AS double) ELSE ep_r END AS AOP1064""",
        f"""CASE WHEN {micro} THEN cast(floor(tp / 100) AS double)
             WHEN {small} THEN cast(floor(tp / 3) AS double)
             WHEN year >= 1998 OR mb % 7 > 3 THEN tp * 5 WHEN mb % 2 = 0 THEN 0D END AS AOP59""",
        f"""CASE WHEN {micro} THEN 5D WHEN {small} THEN 30D WHEN (mb + year) % 23 = 0 THEN NULL
             ELSE qty END AS AOP9005""",
        """CASE WHEN mb % 5 = 0 THEN NULL WHEN mb % 97 = 1 THEN 1D WHEN mb % 11 = 2 THEN 3D
             WHEN mb % 11 = 3 THEN 4D WHEN mb % 11 = 4 THEN 5D ELSE 2D END AS AOP9002""",
        "CASE WHEN mb % 3 = 0 THEN NULL WHEN mb % 4 = 1 THEN 51D ELSE 0D END AS AOP9003",
    )
