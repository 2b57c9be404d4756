"""Blocks with a halo: a rolling frame in parallel inside a series.

Rows are range-partitioned and sorted by (partition columns, order columns), so one huge series, or a table that is one series, spreads over all
tasks. Each row gets its global number; number // block_rows is its block; the last window - 1 rows of a block are repeated at the start of the
next. Any trailing frame of at most window rows then lies inside one block, and repeated rows are dropped after the operator ran.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import OWN, Series

BLOCK, NUMBER, HALO = f"{OWN}block", f"{OWN}number", f"{OWN}halo"


def shared_folder(df: DataFrame) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, where driver and executors are one machine."""
    import tempfile

    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frameflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def numbered(df: DataFrame, series: Series) -> DataFrame:
    """Global row numbers in (partition, order) order, without gathering rows in one task.

    The sorted rows are written first, because range bounds are sampled and may differ when a lost partition is computed again.
    """
    spark, keys = df.sparkSession, [*series.partition_by, *series.order_by]
    path = f"{shared_folder(df)}/frameflow/sorted-{uuid.uuid4().hex}"
    at = F.monotonically_increasing_id()
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(NUMBER, at).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(NUMBER, T.LongType())])).parquet(path)
    part = F.shiftright(NUMBER, 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = F.broadcast(spark.createDataFrame(offsets, f"{OWN}p long, {OWN}base long"))  # as many rows as partitions
    placed = rows.withColumn(f"{OWN}p", part.cast("long")).join(table, f"{OWN}p")
    return placed.withColumn(NUMBER, F.col(f"{OWN}base") + F.col(NUMBER).bitwiseAND((1 << 33) - 1)).drop(f"{OWN}p", f"{OWN}base")


def halo_blocks(df: DataFrame, series: Series, block_rows: int = 250_000) -> DataFrame:
    """The rows with BLOCK, NUMBER and HALO columns; rows with HALO are repetitions."""
    window = series.window
    size = max(block_rows, window)
    rows = numbered(df, series)
    late = F.col(NUMBER) % size > size - window
    blocks = F.when(late, F.array(F.floor(F.col(NUMBER) / size), F.floor(F.col(NUMBER) / size) + 1)).otherwise(F.array(F.floor(F.col(NUMBER) / size)))
    spread = rows.select("*", F.posexplode(blocks).alias(HALO, BLOCK))
    return spread.withColumn(HALO, F.col(HALO) > 0)
