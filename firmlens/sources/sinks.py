"""Sinks: the CSV summary and tables written once and read many times."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", null_text: str = "") -> None:
    """Write a report (a few rows by construction) as one CSV file with a header.

    A missing value is written as `null_text`: empty by default, "NA" for readers that
    expect that word.
    """
    writer = df.coalesce(1).write.mode(mode).option("header", True)
    writer.option("nullValue", null_text).csv(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    The columnar copy survives the loss of executors and later readers prune its
    columns. Each call writes a folder of its own; `release` removes it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove the folders behind tables that `materialize` returned; others stay as they are."""
    for table in tables:
        path = table.__dict__.pop("_written_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, else the context's checkpoint folder.

    Where neither is set, a folder in the warehouse, if all executors can be taken to share it: on a
    cluster its path must name a store other than a machine's own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
        one_machine = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        if not one_machine and re.match(r"file:|/|(?!\w+:)", folder):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")
