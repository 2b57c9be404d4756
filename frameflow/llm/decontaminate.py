"""Benchmark decontamination by winnowing.

From every run of GUARANTEE - GRAM + 1 consecutive GRAM-word hashes the smallest is kept as a fingerprint, on both sides, so any shared span
of GUARANTEE words has a fingerprint in common. Matching fingerprints are candidate alignments; each is extended, word by word, to the whole
windows around it that agree. Items with fewer than WINDOW words are a window of their own and are looked up by the hash of the whole item.

Defined results: null and wordless texts have no words, so neither hits nor, as an item, windows. Repeated documents are judged each; items that
share an item_id count once. item_ids are compared as strings; an item with a null id takes part as "". Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, gram_hashes, written
from .bpe import text_batches

#: Words in a window; words in a fingerprinted gram. Windows of up to WINDOW words are found: span >= WINDOW = run + GRAM - 1.
WINDOW, GRAM = 13, 6
#: Bytes of benchmark text up to which the whole benchmark goes to every task; a larger one is joined by fingerprint.
BROADCAST_BYTES = 8_000_000

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MEMO = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of 0-9, a-z (A-Z lower-cased) and every character beyond ASCII."""
    return _MEMO.of((text or "").encode().translate(_KEEP).split())


def fingerprints(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed grams: the rightmost smallest of every window of window - gram + 1 grams."""
    g = gram_hashes(h, gram)
    run = window - gram + 1
    if len(g) < run:
        return np.empty(0, np.int64), g[:0]
    best, n = g[: len(g) - run + 1].copy(), len(g) - run + 1
    at = np.arange(n)
    for i in range(1, run):
        less = g[i : i + n] <= best
        best = np.where(less, g[i : i + n], best)
        at = np.where(less, np.arange(i, i + n), at)
    at = np.unique(at)
    return at, g[at]


class Items:
    """Benchmark items as word hashes, with the fingerprints of the long ones and the whole hashes of the short ones."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = [i for i, _ in rows]
        self.words = [word_hashes(t) for _, t in rows]
        long_at = [(k, *fingerprints(h, window, gram)) for k, h in enumerate(self.words) if len(h) >= window]
        self.prints = np.concatenate([p for _, _, p in long_at] or [np.empty(0, np.uint64)])
        self.item = np.concatenate([np.full(len(p), k) for k, _, p in long_at] or [np.empty(0, np.int64)])
        self.at = np.concatenate([a for _, a, _ in long_at] or [np.empty(0, np.int64)])
        order = np.argsort(self.prints, kind="stable")
        self.prints, self.item, self.at = self.prints[order], self.item[order], self.at[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(h) for h in self.words} & {*range(1, window)}):
            ks = np.array([k for k, h in enumerate(self.words) if len(h) == n])
            whole = np.array([gram_hashes(self.words[k], n)[0] for k in ks], np.uint64)
            order = np.argsort(whole, kind="stable")
            self.short[n] = whole[order], ks[order]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words of a document lie in an occurring window, and the ids of the items that have one."""
        cover, found = np.zeros(len(h) + 1, np.int64), set()
        for n, (whole, ks) in self.short.items():
            g = gram_hashes(h, n)
            for p, k in zip(*_matches(g, whole), strict=True):
                cover[p] += 1
                cover[p + n] -= 1
                found.add(self.ids[ks[k]])
        at, prints = fingerprints(h, self.window, self.gram)
        done: set[tuple[int, int]] = set()
        for p, k in zip(*_matches(prints, self.prints), strict=True):
            item, shift = int(self.item[k]), int(at[p]) - int(self.at[k])
            if (item, shift) in done:
                continue
            done.add((item, shift))
            for i, j in _agreeing(h, self.words[item], shift, self.window):
                cover[i] += 1
                cover[j] -= 1
                found.add(self.ids[item])
        return np.cumsum(cover[:-1]) > 0, found


def _matches(a: np.ndarray, sorted_b: np.ndarray) -> tuple[list[int], list[int]]:
    """All index pairs of equal values."""
    lo, hi = np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right")
    some = np.flatnonzero(hi > lo)
    return [int(p) for p in some for _ in range(hi[p] - lo[p])], [k for p in some for k in range(lo[p], hi[p])]


def _agreeing(doc: np.ndarray, item: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Spans of the document, least words or longer, that agree with the item moved by shift."""
    i, j = max(0, shift), min(len(doc), shift + len(item))
    same = np.r_[False, doc[i:j] == item[i - shift : j - shift], False]
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(i + int(a), i + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _verdict(h: np.ndarray, hit: np.ndarray, found: set[str]) -> tuple:
    n_hit = int(hit.sum())
    return len(h), n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(h)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", carry: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, and the columns named in carry.

    A benchmark whose measured bytes stay within broadcast_bytes goes to every task, and documents are scanned once without a shuffle. A larger
    one is joined by fingerprint, which shuffles fingerprints of both sides and then the documents that have candidates.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("itext"))
    size = items.agg(F.sum(F.octet_length("item") + F.octet_length("itext"))).first()[0] or 0
    if size <= broadcast_bytes:
        known = Items([(r.item, r.itext) for r in items.collect()], window, gram)
        return _scan(df, known, id_col, text_col, carry or [])
    return _join(df, items, id_col, text_col, carry or [], window, gram)


def _scan(df: DataFrame, known: Items, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(known)
    names = [id_col, *carry]
    rest = [c for c in names if c != text_col]  # the text is sent once, carried or not
    kept = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, 0):
            rows = []
            for t in texts:
                h = word_hashes(t)
                rows.append(_verdict(h, *shared.value.hits(h)))
            held = dict(zip([text_col, *rest], part.columns, strict=True))
            yield pa.RecordBatch.from_arrays([*[held[c] for c in names], *_columns(rows)], [*names, *[c.split()[0] for c in _SCHEMA.split(", ")]])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(run, f"{kinds}, {_SCHEMA}")


def _join(df: DataFrame, items: DataFrame, id_col: str, text_col: str, carry: list[str], window: int, gram: int) -> DataFrame:
    """Candidates by a join on fingerprints; every document then meets only the items that share one with it.

    Rows get an own key, so that repeated or null ids do no harm; keyed rows are written first, so the keys hold if an executor is lost.
    """
    names = [id_col, *carry]
    rest = [c for c in names if c != text_col]
    docs = written(df.select(F.monotonically_increasing_id().alias("_key"), F.col(f"`{text_col}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")), "decontam-docs")
    bench = written(items.select(F.monotonically_increasing_id().alias("_item"), "item", "itext"), "decontam-items")
    lengths = sorted(r[0] for r in _prints(bench, "_item", "itext", window, gram, None).select("n").distinct().collect())
    short = [n for n in lengths if n < window]  # at most window - 1 numbers
    a = _prints(docs, "_key", "_text", window, gram, short).distinct()
    b = _prints(bench, "_item", "itext", window, gram, None).distinct()
    pairs = a.join(b, ["n", "print"]).select("_key", "_item").distinct()
    near = pairs.join(bench, "_item").join(docs.select("_key", "_text"), "_key")

    def extend(batches):
        for batch in batches:
            out = {"_key": [], "item": [], "hit": []}
            for row, item, itext, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "item", "itext", "_text")), strict=True):
                hit, found = Items([(item, itext)], window, gram).hits(word_hashes(text))
                if found:
                    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                    out["_key"].append(row), out["item"].append(item), out["hit"].append(edges.tolist())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_key", pa.int64()), ("item", pa.string()), ("hit", pa.list_(pa.int64()))]))

    spans = near.select("_key", "item", "itext", "_text").mapInArrow(extend, "_key long, item string, hit array<long>")
    found = spans.groupBy("_key").agg(F.collect_set("item").alias("_items"), F.flatten(F.collect_set("hit")).alias("_hit"))
    kept = docs.join(found, "_key", "left").select("_text", "_items", "_hit", *[F.col(f"_rest.`{c}`") for c in rest])

    def judge(batches):
        for part, texts in text_batches(batches, 0):
            rows = []
            for t, found, edges in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                h = word_hashes(t)
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, np.array((edges or [])[::2], np.int64), 1)
                np.add.at(cover, np.array((edges or [])[1::2], np.int64), -1)
                rows.append(_verdict(h, np.cumsum(cover[:-1]) > 0, set(found or ())))
            held = dict(zip([text_col, *rest], [part.column(0), *part.columns[3:]], strict=True))
            yield pa.RecordBatch.from_arrays([*[held[c] for c in names], *_columns(rows)], [*names, *[c.split()[0] for c in _SCHEMA.split(", ")]])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(judge, f"{kinds}, {_SCHEMA}")


def _prints(df: DataFrame, key: str, text: str, window: int, gram: int, short: list[int] | None) -> DataFrame:
    """(key, n, print): fingerprints with n = window; whole hashes of n words, of the text itself (short None) or of each length in short."""

    def run(batches):
        for part, texts in text_batches(batches, 1):
            keys, ns, prints = [], [], []
            for k, t in zip(part.column(0).to_pylist(), texts, strict=True):
                h = word_hashes(t)
                own = short if short is not None else [len(h)] if 0 < len(h) < window else []
                for n, p in [(window, fingerprints(h, window, gram)[1]), *((n, gram_hashes(h, n)) for n in own)]:
                    keys.append(np.full(len(p), k))
                    ns.append(np.full(len(p), n))
                    prints.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(ns).astype(np.int32)), pa.array(np.concatenate(prints).view(np.int64))], [key, "n", "print"])

    return df.select(key, text).mapInArrow(run, f"{key} long, n int, print long")
