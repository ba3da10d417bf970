"""Typed scan and validation of the annual-statement table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_COLUMNS = ("mb", "year", "name")

# Statement form codes of the consumed measures.
MEASURE_COLUMNS = (
    "AOP1001",
    "AOP1025",
    "AOP1026",
    "AOP1043",
    "AOP1055",
    "AOP1064",
    "AOP59",
    "AOP9005",
    "AOP9002",
    "AOP9003",
)


def read_statements(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    years: tuple[int, int] | None = None,
    **options,
) -> DataFrame:
    """Scan statements and return the consumed columns with fixed types.

    `years` are exclusive bounds: a numeric year column is compared in its own type before the
    cast, so that the bounds reach the scan and prune year folders.
    Text formats are read as strings, so a cell that is no number becomes NULL
    without losing the rest of its row.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return typed_statements(reader.options(**options).load(path), years)


def typed_statements(raw: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    """Cast to (mb long, year int, name string, measures double); NaN becomes NULL.

    Text ids are read as whole numbers first, so that no digit is lost. A year that is no
    whole number is NULL. Rows outside the exclusive bounds `years` are left out.
    """
    missing = [c for c in (*REQUIRED_COLUMNS, *MEASURE_COLUMNS) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing source columns: {', '.join(missing)}")
    types = dict(raw.dtypes)
    if years:
        bounded = types["year"] in ("tinyint", "smallint", "int", "bigint", "float", "double")
        year = "year" if bounded else "try_cast(year AS double)"
        raw = raw.where(f"{year} > {years[0]} AND {year} < {years[1]}")
    return raw.selectExpr(
        _cast("mb", types["mb"], "bigint"),
        _cast("year", types["year"], "int"),
        _cast("name", types["name"], "string"),
        *[f"nanvl({_cast(c, types[c], 'double')}, NULL) AS {c}" for c in MEASURE_COLUMNS],
    )


def _cast(name: str, have: str, want: str) -> str:
    if have == want:
        return name  # no cast, so filters still reach the file scan
    cast = f"try_cast({name} AS {want})"
    if want in ("int", "bigint") and (have == "string" or have in ("float", "double")):
        number = f"try_cast({name} AS double)"
        whole = f"CASE WHEN {number} = floor({number}) THEN try_cast({number} AS {want}) END"
        cast = f"coalesce({cast}, {whole})" if have == "string" else whole
    return cast if want == "double" else f"{cast} AS {name}"


def source_profile(raw: DataFrame) -> DataFrame:
    """One row: shape, presence of the key columns and the range of years."""
    present = all(c in raw.columns for c in REQUIRED_COLUMNS)
    year = F.col("year") if "year" in raw.columns else F.lit(None).cast("int")
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(raw.columns)).cast("bigint").alias("n_columns"),
        F.lit(present).alias("has_key_columns"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )
