import duckdb
import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] else 0) for r in rows
        ]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


@pytest.fixture(scope="session")
def sql():
    """Rows of a DuckDB statement over the given tables."""

    def run(statement, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(name, df.toArrow())
        return con.execute(statement).fetchall()

    return run


def rows_of(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
