"""Parallelism and runtime facts."""

from __future__ import annotations

import platform

import pyspark
from pyspark.sql import SparkSession

from ..plans.frames import whole


def set_parallelism(spark: SparkSession, n: int) -> None:
    """Partitions that a shuffle makes, and so the tasks that work on series at once."""
    spark.conf.set("spark.sql.shuffle.partitions", str(whole(n, "n", 1)))


def get_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runtime_info(spark: SparkSession) -> dict[str, str]:
    """What the work runs on."""
    import pyarrow

    return {
        "spark": spark.version, "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "python": platform.python_version(),
        "codegen": spark.conf.get("spark.sql.codegen.wholeStage", "true"), "adaptive": spark.conf.get("spark.sql.adaptive.enabled", "true"),
    }
