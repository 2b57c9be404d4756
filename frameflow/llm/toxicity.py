"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and context windows around each hit.

The lexicon is learned from labelled documents: words, and stems of words, that mark toxic ones. Fixed terms stand in for what labels say nothing of:
all where there are no labels of both kinds or nothing could be learned, else those that no document of the sample holds. Each distinct word of the
corpus becomes a Levenshtein automaton (one edit; a swap of neighbours is one) that is walked together with the trie, so misspelled terms are found
without listing them. A hit is told apart as exact, misspelled, or a misspelled short term (whole words only, as ordinary words are near to those) and,
by the quotation marks in a window around it, as quoted or not; windows dense with hits count more. A logistic regression on these counts gives the
score.

The fit takes at most SAMPLE labelled documents (half of each kind where there are so many, weighted back to their true share), chosen by a hash of
their id; everything else covers all rows. Defined results: null and empty texts have no hits and get the score of such texts; a document
labelled twice counts as toxic if any label says so, and so do labelled documents of equal text; null labels and labels of unknown documents are ignored; without labels of both kinds fixed
weights are used. Other columns are ignored unless named in carry.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, gram_hashes, mixed, written
from .bpe import text_batches

#: Labelled documents that the fit may take; words on each side of a hit that are its context.
SAMPLE, CONTEXT = 10_000, 8
#: Least letters of a term that may be misspelled as a whole word and as the beginning of one, least and most letters of a learned stem.
SHORT_LETTERS, FUZZY_LETTERS, STEM_LETTERS = 4, 6, (3, 14)
#: A learned stem has this share of toxic documents among its documents, is in this many of them that are no near copies of each other, and has this
#: log-likelihood ratio (chi-squared of one degree), with and without such copies.
STEM_SHARE, STEM_SUPPORT, STEM_RATIO = 0.9, 5, 25.0
#: Documents that share one of COPIES groups of MINIMA smallest hashes of their runs of three words are taken for near copies here.
MINIMA, COPIES = 3, 10
MEMO = 400_000

# Terms of the lexicon of which the labels may say nothing.
TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting")
# Weights where there are no labels to learn from, in the order of features(), the constant first.
WEIGHTS = (-4.0, 4.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.5, 1.0)

_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”„«»‘’…¿¡–—"
_OPEN, _CLOSE = re.compile(r'^[(\[]*["“„«‘]'), re.compile(r'["”“»’][)\].,;:!?]*$')


class Lexicon:
    """A trie of whole words and of stems (a stem matches every word that begins with it)."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = sorted(set(words)), sorted(set(stems))
        self.root: dict = {}
        for term, mark in [*((w, "word") for w in self.words), *((s, "stem") for s in self.stems)]:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[mark] = len(term)
        self.memo: dict[str, int | None] = {}

    def __getstate__(self):
        return self.words, self.stems

    def __setstate__(self, state):
        self.__init__(*state)

    def distance(self, chunk: str) -> int | None:
        """0: the chunk's word is in the lexicon; 1: one edit away; 2: one edit away from a short term; None: none of these."""
        word = chunk.strip(_EDGES).lower()
        if not word:
            return None
        n, at = len(word), {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        whole, best = 1 << n, None
        # Bit i: i characters of the word are read, without an error and with at most one; then the first of these, and the places of the character, one before.
        states = [(self.root, 1, 3, 0, 0)]
        while states:
            node, none, one, earlier, last = states.pop()
            for c, below in node.items():
                if c in ("word", "stem"):
                    ends = whole if c == "word" else ~0
                    if none & ends:
                        return 0
                    if below >= FUZZY_LETTERS and one & ends:
                        best = 1
                    elif below >= SHORT_LETTERS and one & whole and best is None:
                        best = 2
                    continue
                here = at.get(c, 0)
                same = (none & here) << 1
                swapped = ((earlier & here) << 1 & last) << 1
                other = (one & here) << 1 | none << 1 | none | same << 1 | swapped
                if other:
                    states.append((below, same, other, none, here))
        return best

    def features(self, text: str) -> list[float]:
        """Logarithms of: exact hits, misspelled hits, both again in quotes, misspelled short ones, these in quotes, exact hits per 100 words, most exact
        and misspelled hits in one window."""
        chunks = text.split()
        memo = self.memo
        distinct = set(chunks)
        if len(memo) + len(distinct) > MEMO:
            memo.clear()
        hit = set()
        for chunk in distinct:
            if chunk not in memo:
                memo[chunk] = self.distance(chunk)
            if memo[chunk] is not None:
                hit.add(chunk)
        hits = [i for i, chunk in enumerate(chunks) if chunk in hit] if hit else []
        if not hits:
            return [0.0] * 8
        counts = [0] * 6
        for i in hits:
            before, after = chunks[max(0, i - CONTEXT) : i + 1], chunks[i : i + CONTEXT + 1]
            opened = next((k for k, c in enumerate(reversed(before)) if _OPEN.search(c)), None)
            closed = next((k for k, c in enumerate(after) if _CLOSE.search(c)), None)
            since = next((k for k, c in enumerate(reversed(before[:-1]), 1) if _CLOSE.search(c)), CONTEXT + 1)
            quoted = opened is not None and closed is not None and opened < since
            kind = memo[chunks[i]]
            counts[kind + 2 * quoted if kind < 2 else 4 + quoted] += 1
        sure = [i for i in hits if memo[chunks[i]] < 2]
        dense, j = 0, 0
        for k, i in enumerate(sure):
            while sure[j] < i - 2 * CONTEXT:
                j += 1
            dense = max(dense, k - j + 1)
        return [math.log1p(x) for x in (*counts, 100 * counts[0] / len(chunks), dense)]


class Model:
    def __init__(self, lexicon: Lexicon, weights):
        self.lexicon, self.weights = lexicon, [float(w) for w in weights]

    def score(self, text: str) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.lexicon.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32(id as text) mod folds is fold; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from the labelled documents that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_y"))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model(Lexicon(list(TERMS), []), WEIGHTS)
    order = F.xxhash64("_id"), "_id"
    chosen = known.where("_y").orderBy(*order).limit(sample // 2).union(known.where("NOT _y").orderBy(*order).limit(sample // 2))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_text").agg(F.max("_y").alias("_y"))  # sample rows at most; of equal texts any label that says so
    rows = written(rows, "toxicity-sample")
    stems = _needed(rows, _stems(rows))
    there = rows.agg(*[F.max(F.lower("_text").contains(t)).alias(t) for t in TERMS]).first().asDict()
    lexicon = Lexicon([t for t in TERMS if not (stems and there[t])], stems)  # of terms that the sample holds, its labels decide
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for part, texts in text_batches(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.features(t) for t in texts], pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    found = rows.mapInArrow(run, "x array<double>, y boolean").collect()
    if len({r.y for r in found}) < 2:
        return Model(lexicon, WEIGHTS)
    return Model(lexicon, logistic(np.array([r.x for r in found]), np.array([r.y for r in found], float), totals))


def _stems(rows: DataFrame) -> list[str]:
    """Learned stems: beginnings of words that mark toxic documents, as long as nearly all their documents allow."""
    low, high = STEM_LETTERS

    def run(batches):
        seen: dict[str, list[int]] = {}
        for part, texts in text_batches(batches, 0):
            for t, y in zip(texts, part.column(1).to_pylist(), strict=True):
                words = {w for c in set(t.split()) if len(w := c.strip(_EDGES).lower()) >= low and w.isalpha()}
                for start in {w[:n] for w in words for n in range(low, min(len(w), high) + 1)}:
                    seen.setdefault(start, [0, 0])[y] += 1
            if len(seen) > 2_000_000:
                yield _counted(seen)
                seen = {}
        yield _counted(seen)

    counts = rows.mapInArrow(run, "start string, clean long, toxic long").groupBy("start").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()
    toxic, clean = (sum(r.n for r in n if r._y is k) for k in (True, False))
    rate = max(toxic, 1) / max(toxic + clean, 1)
    found = {r.start: r.toxic for r in counts.where((F.col("toxic") >= STEM_SUPPORT) & (F.col("toxic") >= STEM_SHARE * (F.col("toxic") + F.col("clean")))).collect()
             if 2 * r.toxic * math.log(r.toxic / ((r.toxic + r.clean) * rate)) + (2 * r.clean * math.log(max(r.clean, 1e-9) / ((r.toxic + r.clean) * max(1 - rate, 1e-9))) if r.clean else 0) >= STEM_RATIO}
    longer: dict[str, list[str]] = {}
    for start in found:
        longer.setdefault(start[:-1], []).append(start)
    stems = []
    for start in sorted(found, key=lambda s: (len(s), s)):
        if start[:-1] in found:
            continue  # its beginning is marked already
        while (best := max(longer.get(start, ()), key=found.get, default=None)) and found[best] >= 0.95 * found[start]:
            start = best
        stems.append(start)
    return stems


def _needed(rows: DataFrame, stems: list[str]) -> list[str]:
    """Of stems those that enough toxic documents have, near copies of one another counted once, as any rare word of a text with many copies would
    do otherwise. Works on the sample's toxic documents only."""
    wanted = set(stems)
    low, high = STEM_LETTERS

    def run(batches):
        memo = WordHashes()
        for _, texts in text_batches(batches, 0):
            found, keys = [], []
            for t in texts:
                chunks = t.split()
                words = {c.strip(_EDGES).lower() for c in set(chunks)}
                found.append(sorted({w[:n] for w in words for n in range(low, min(len(w), high) + 1)} & wanted))
                grams = gram_hashes(memo.of([c.lower().encode() for c in chunks]), min(3, len(chunks))) if chunks else np.empty(0, np.uint64)
                least = [mixed(grams + np.uint64(i)).min() for i in range(MINIMA * COPIES if len(grams) else 0)]
                keys.append(gram_hashes(np.array(least, np.uint64), MINIMA)[::MINIMA].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.int64()))], ["found", "keys"])

    marked = rows.where("_y").select("_text").mapInArrow(run, "found array<string>, keys array<long>").collect()
    part, first = list(range(len(marked))), {}

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    for i, r in enumerate(marked):
        for k in enumerate(r["keys"]):
            part[root(i)] = root(first.setdefault(k, i))
    groups: dict[str, set[int]] = {s: set() for s in stems}
    for i, r in enumerate(marked):
        for s in r.found:
            groups[s].add(root(i))
    rate = max(len(marked), 1) / max(rows.count(), 1)
    return [s for s in stems if len(groups[s]) >= STEM_SUPPORT and -2 * len(groups[s]) * math.log(rate) >= STEM_RATIO]


def _counted(seen: dict[str, list[int]]) -> pa.RecordBatch:
    clean, toxic = zip(*seen.values(), strict=True) if seen else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["start", "clean", "toxic"])


def logistic(x: np.ndarray, y: np.ndarray, totals: dict[bool, int], ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method with a ridge; each kind weighs as much as it has rows in all, relative to the sample."""
    x = np.c_[np.ones(len(x)), x]
    share = {k: totals[k] / max(1, (y == k).sum()) for k in (True, False)}
    weight = np.where(y > 0, share[True], share[False])
    weight = weight * len(y) / weight.sum()
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row: id, score, predicted, and the columns named in carry. One pass, no shuffle."""
    shared, names = df.sparkSession.sparkContext.broadcast(model), [id_col, *(carry or [])]
    rest = [c for c in names if c != text_col]  # the text is sent once, carried or not

    def run(batches):
        for part, texts in text_batches(batches, 0):
            scores = [shared.value.score(t) for t in texts]
            held = dict(zip([text_col, *rest], part.columns, strict=True))
            yield pa.RecordBatch.from_arrays([*[held[c] for c in names], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*names, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{kinds}, score double, predicted int")
