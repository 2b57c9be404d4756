"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir) that returns the documents that stay.

Stages pass rows on whole: a document's own columns but its text ride along in one struct, so a column of any name does no harm. Null texts count as
empty in every stage and stay null. Rows with a null doc_id are judged by their text; the n-gram Jaccard join links them with nothing. Rows that share
a doc_id are judged each by its text. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameflow.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from frameflow.llm._shared import written


CARRY = ["_row", "text"]


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def _as_before(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.select(*["text" if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels table calls toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as_before(toxicity.score(_with_row(docs), model, carry=CARRY).where("predicted = 0"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id stays."""
    return exact_dedup.unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, directly or through others, the one with the smallest doc_id stays."""
    found = written(jaccard_join.linked_rows(docs, n=5, num=80, den=100), "pipeline-linked")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "tag")).alias("s")).select("s.id", "s.tag")
    stay = first.union(found.where("root IS NULL AND id IS NOT NULL").select("id", "tag"))
    same = (docs["doc_id"] == stay["id"]) & (jaccard_join.text_tag(docs["text"]) == stay["tag"])
    return docs.where("doc_id IS NOT NULL").join(stay, same, "left_semi").union(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are windows of benchmark items go."""
    found = decontaminate.contamination(_with_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=CARRY)
    return _as_before(found.where("NOT contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left: doc_id, n_tokens, ids."""
    import public_tokenizers

    ids = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: The toxicity stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
