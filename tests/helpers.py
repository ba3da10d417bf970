"""Small statement tables for tests."""

from pyspark.sql import types as T

from firmlens.sources.statements import MEASURE_COLUMNS

SCHEMA = T.StructType(
    [
        T.StructField("mb", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("name", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in MEASURE_COLUMNS],
    ]
)

# A large, private, domestic firm-year with small margins.
DEFAULTS = {
    "mb": 1,
    "year": 2018,
    "name": "Firm",
    "AOP1001": 9.0e6,
    "AOP1025": 9.0e5,
    "AOP1026": None,
    "AOP1043": 9.5e6,
    "AOP1055": 5.0e5,
    "AOP1064": None,
    "AOP59": 8.0e6,
    "AOP9005": 300.0,
    "AOP9002": 2.0,
    "AOP9003": None,
}


def statements(spark, *rows):
    """One statement per dict; unnamed columns take the defaults."""
    from firmlens.sources import typed_statements

    data = [tuple({**DEFAULTS, **row}[f.name] for f in SCHEMA) for row in rows]
    return typed_statements(spark.createDataFrame(data, SCHEMA))
