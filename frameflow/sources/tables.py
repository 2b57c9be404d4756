"""Series come from any table Spark reads; only the columns that are named reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.frames import names


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_series(spark: SparkSession, path: str, values, order_by, partition_by=None, format: str = "parquet", schema=None, **options) -> DataFrame:
    """Order, partition and value columns of a file or folder (parquet, orc, csv, json, ...). Text formats need a schema: nothing is inferred."""
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    wanted = list(dict.fromkeys([*names(partition_by), *names(order_by), *names(values)]))
    return reader.load(path).select(*wanted)


def write_results(df: DataFrame, path: str, format: str = "parquet", partition_by=None, mode: str = "errorifexists") -> None:
    writer = df.write.format(format).mode(mode)
    (writer.partitionBy(*names(partition_by)) if partition_by else writer).save(path)
