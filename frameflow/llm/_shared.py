"""What several operators need: the shared folder, tables written to cut lineage, and word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's memo of word hashes may hold; beyond it the memo starts anew (results do not change).
MEMO = 200_000

#: Bytes that a writer of such a table holds before it writes them.
ROW_GROUP = 32 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frameflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/frameflow/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; the shuffle files of this one job are removed after it, as nothing can read them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with its path, for a table that is removed when it has served."""
    save(df, path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def put_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file from a task: under a name of this attempt, then renamed, so a lost or repeated task leaves no half file."""
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    own = f"{at}/.{name}.{os.urandom(8).hex()}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{at}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to MEMO entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words, from the words' hashes; order matters."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out) + h[i : len(h) - n + 1 + i]
    return mixed(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (columns a, b) with the smallest node that it is connected to.

    Alternating large-star and small-star rounds (the MapReduce form of union-find): every edge moves towards the smallest node known, until
    nothing changes. Only DataFrame operations; minima are combined before each shuffle, so a node of any degree sends a row per task, and
    a hot node's join is split by AQE. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    edge = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).alias("e")
    now, state, path = edges.where("a <> b").select(edge).select("e.*").distinct(), None, None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = moved.union(lowest.select("a", "m")).distinct()
        save(after, fresh := new_path(spark, "stars"))
        if path:
            remove(spark, path)
        path, now = fresh, spark.read.schema(after.schema).parquet(fresh)
        before, state = state, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
