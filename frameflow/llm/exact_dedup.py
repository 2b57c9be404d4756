"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

Defined results: a null text counts as empty. A null id never becomes keep_id unless every id of its group is null; then keep_id is
null and the rows are kept. Rows that repeat an id and its text are one document, so each repeat carries the same verdict (unique_rows
returns one of them). Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hashed=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Equality is decided by bytes: the grouping key is (hash, text), combined before the shuffle, so a group of any size sends one row per
    task. Only hashes under which two different texts were found (none, unless the hash is broken) are matched by text again.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_h", hashed(F.col("_t")))
    texts = rows.groupBy("_h", "_t").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    found = written(texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.sum("_n").alias("_n")), "exact-groups")
    light = rows.select("_id", "_h", F.unhex(F.sha2("_t", 256)).alias("_sha"))
    joined = light.join(found.where("_texts = 1").drop("_texts"), "_h")
    if not found.where("_texts > 1").isEmpty():
        clash = found.where("_texts > 1").select("_h")
        apart = rows.join(clash, "_h", "left_semi")
        again = apart.groupBy("_h", "_t").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        joined = joined.unionByName(apart.join(again, ["_h", "_t"]).select("_h", "_id", F.unhex(F.sha2("_t", 256)).alias("_sha"), "_keep", "_n"))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def unique_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with all their columns: one per distinct text (null and empty are equal), by one shuffle of the texts.

    Copies meet in a combining aggregate keyed by (hash, text), so a huge group of copies leaves each task as one row. Of rows with equal
    ids any one stays; a null id stays only where its group has no other.
    """
    best, order = (F.min_by, F.col(id_col)) if keep == "min" else (F.max_by, F.col(id_col))
    names = df.columns
    key = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") if c != text_col else F.col(f"`{c}`").isNull().alias(c) for c in names])
    lean = df.select(content_hash(key).alias("_h"), key.alias("_t"), order.alias("_o"), row.alias("_r"))
    picked = lean.groupBy("_h", "_t").agg(F.coalesce(best("_r", "_o"), F.first("_r")).alias("_r"))
    return picked.select(*[F.col(f"_r.`{c}`") if c != text_col else F.when(~F.col(f"_r.`{c}`"), F.col("_t")).alias(c) for c in names])
