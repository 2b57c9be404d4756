"""Secret scans: candidate strings, judged by a random forest so that false positives drop out. DataFrame and SQL functions only.

A candidate is a run of 16 or more characters of keys and encodings, with digits or capitals inside, in any word of a text. Its features are length,
shares of digits, capitals and distinct characters, transitions between character classes, coverage by fragments of plain words, signs of a path,
and the words before and after. The forest (Spark ML, in the JVM) learns from labelled findings: those that are passed, of which TRAINING rows at
most are taken by a hash, or a fixed made-up set of secrets and of things that look like them.

Defined results: null and empty texts and texts without candidates have no rows; a candidate that occurs twice has a row for each place; rows are
repeated as their documents are; a null id stays null. Candidates are never cut, whatever their length. Other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings that the forest may take; words on each side of a candidate that count; trees and their depth.
TRAINING, NEIGHBOURS, TREES, DEPTH = 5_000, 3, 20, 6

# What a candidate is made of, words that go with secrets, words that go with public digests, and fragments of plain words.
CANDIDATE = "[A-Za-z0-9+/_-]{16,}={0,2}"
TELLING = "token|secret|passw|pwd|api|auth|bearer|credential|private|access|key"
PUBLIC = "commit|sha|md5|digest|checksum|hash|etag|uuid|guid|revision|integrity|card|phone|order|path|file|http"
FRAGMENTS = "tion|ment|ing|the|and|able|ness|data|test|name|user|type|list|file|view|model|page|index|value|config|service|manager|handler|example|sample"
FEATURES = ("size", "digits", "capitals", "distinct", "changes", "covered", "slashes", "hex", "numeric", "assigned", "quoted", "telling", "public")


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_no, finding, before, word, after) for each candidate; before and after are the neighbouring words."""
    words = df.select(F.col(id_col).alias("_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+").alias("_w"))
    long = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.length(x["w"]) >= 16)
    # Long words are few; only they meet the patterns.
    found = words.select("_id", "_w", F.explode(long).alias("_x")).select("_id", F.col("_x.i").alias("_i"), F.col("_x.w").alias("_word"), "_w")
    found = found.where(F.col("_word").rlike(CANDIDATE))
    around = found.select(
        "_id", "_i", "_word",
        F.array_join(F.slice("_w", F.greatest(F.col("_i") + 1 - NEIGHBOURS, F.lit(1)), F.least(F.col("_i"), F.lit(NEIGHBOURS))), " ").alias("before"),
        F.array_join(F.slice("_w", F.col("_i") + 2, NEIGHBOURS), " ").alias("after"),
    )
    each = around.select("_id", "_i", "_word", "before", "after", F.explode(F.expr(f"regexp_extract_all(_word, '{CANDIDATE}', 0)")).alias("finding"))
    mixed = F.col("finding").rlike("[0-9]") | F.col("finding").rlike("[a-z][A-Z]")
    return each.where(mixed).select(F.col("_id").alias("id"), F.col("_i").alias("word_no"), "finding", "before", F.col("_word").alias("word"), "after")


def with_features(df: DataFrame) -> DataFrame:
    """Appends FEATURES to rows with finding, before, word and after."""
    f, size = F.col("finding"), F.length("finding").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(f, F.lit(pattern)) / size

    near = F.lower(F.concat_ws(" ", "before", "word"))
    return df.withColumns({
        "size": size, "digits": share("[0-9]"), "capitals": share("[A-Z]"), "distinct": F.size(F.array_distinct(F.split("finding", ""))) / size,
        "changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(f), FRAGMENTS, "")) / size, "slashes": share("[/_-]"),
        "hex": f.rlike("^[0-9a-fA-F]+$").cast("double"), "numeric": f.rlike("^[0-9]+$").cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | F.col("word").rlike("^[^A-Za-z0-9]*[A-Za-z_]+[=:]")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"), "telling": near.rlike(TELLING).cast("double"),
        "public": F.lower(F.concat_ws(" ", "before", "word", "after")).rlike(PUBLIC).cast("double"),
    })


def made_up_findings(spark: SparkSession, n: int = 3000, seed: int = 11) -> DataFrame:
    """Labelled findings to learn from where there are no others: half secrets, half look-alikes, in made-up surroundings."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hexes, keys = "0123456789abcdef", digits + lower + upper
    syllables = ["an", "er", "in", "ou", "st", "le", "re", "en", "la", "ti", "do", "ca"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    camel = lambda: "".join(w.capitalize() for w in rng.sample(FRAGMENTS.split("|"), 4))
    secrets = [lambda: pick(hexes, rng.choice((32, 40, 64))), lambda: "AKIA" + pick(upper + digits, 16), lambda: pick(keys + "+/", 40), lambda: "ghp_" + pick(keys, 36), lambda: pick(keys, rng.randint(20, 64))]
    lead = ["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "bearer"]
    others = [
        (lambda: pick(hexes, 40), ["commit", "revision", "sha1"]), (lambda: pick(hexes, rng.choice((32, 64))), ["md5", "checksum", "digest", "etag"]),
        (lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), ["uuid", "id", "guid"]), (lambda: pick(digits, rng.randint(16, 19)), None),
        (lambda: "/" + "/".join(word() + pick(digits, rng.randint(0, 2)) for _ in range(4)) + "/" + word() * 2, None), (camel, None),
        (lambda: f"{word()}_{word()}_{word()}_{word()}_{pick(digits, 2)}", None), (lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}T{pick(digits, 6)}", None),
    ]
    rows = []
    for k in range(n):
        before, after = [word() for _ in range(3)], " ".join(word() for _ in range(3))
        if k % 2:
            finding, name = rng.choice(secrets)(), rng.choice(lead)
            shape = rng.randrange(3)
            before = [*before[1:], name] if shape == 0 else [before[0], name, rng.choice("=:")] if shape == 1 else before
            shown = f'"{finding}"' if rng.random() < 0.6 else finding
            shown = f"{name}={shown}" if shape == 2 else shown
        else:
            make, names = rng.choice(others)
            finding = make()
            before = [*before[1:], rng.choice(names)] if names else before
            shown = finding + rng.choice(["", "", ",", ".", "***"])
        rows.append((" ".join(before), shown, after, finding, float(k % 2)))
    return spark.createDataFrame(rows, "before string, word string, after string, finding string, label double")


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (before, word, after, finding, label); TRAINING of them at most."""
    few = labelled.where("finding IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("finding", "before", "after")).limit(TRAINING)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(few)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(df: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, word_no, finding, score (of being a secret) and secret. One pass, no shuffle."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(df, id_col, text_col)))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "word_no", "finding", "score", (F.col("score") >= threshold).alias("secret"))
