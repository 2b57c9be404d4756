"""N-gram Jaccard join by PartEnum signatures: which documents are linked, directly or through others.

A document's set holds the hashes of its distinct n-word shingles (64 bits of each; sets are told apart by 128 bits of all of them). Sets fall
into bands of size; two similar sets lie in the same or neighbouring bands, so each set takes part in two instances. An instance parts the
feature domain into n1 x n2 cells such that, of two sets as similar as asked, some first-level part differs in so few features that one of the
enumerated subsets of its second-level cells is equal; a signature is the hash of such a subset. Empty subsets, which are equal in sets that have
nothing in common, are signed only by sets with so many that a partner might share no other. Equal sets are one class and meet once.

Classes that share a signature meet as parity sketches: bit i tells whether an odd number of features hash to i, so two sketches differ in at most
as many bits as the sets do in features, and pairs with more differing bits than similar sets may have are told apart without their texts. No
similar pair is lost. Signatures of more than SKETCHED classes go on without this test. What passes forms clusters (by distributed union-find);
inside a cluster the exact similarity decides. A cluster is worked on in
blocks of bounded size: first every block meets the members that share most signatures, then what is not yet connected meets all blocks.
No set of pairs is ever written: a task returns at most one link for each member and part.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and are their own component. Repeated rows are
copies of each other. A row with a null id is linked with nothing, and its component is null. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WordHashes, components, gram_hashes, mixed, remove, written, written_at
from .bpe import text_batches

#: Shingles in a block of a cluster, and members that every block meets first.
BLOCK_SHINGLES, CENTRES = 500_000, 8
#: Classes of one signature that are compared by their sketches in one task.
SKETCHED = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MEMO = WordHashes()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; of the whole sequence if it is shorter; none without words."""
    h = _MEMO.of((text or "").encode().translate(_LOWER).split())
    return np.unique(gram_hashes(h, min(n, len(h)))) if len(h) else h


class PartEnum:
    """Signatures for sets whose Jaccard similarity is at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]  # smallest size of each band; a partner of a set is in its own or a neighbouring band
        self.plans: dict[int, tuple[int, int, list[tuple[int, ...]], int]] = {}

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def plan(self, band: int) -> tuple[int, int, list[tuple[int, ...]], int]:
        """First-level parts, second-level parts of each, the second-level subsets, and in how many parts at least one subset of two similar sets of
        this band and the next is equal."""
        if band not in self.plans:
            self.band(self.starts[band] * 2)
            low = self.starts[band + 1] - 1
            high = low * self.den // self.num
            apart = (self.den - self.num) * (low + high) // (self.den + self.num)  # most features in one set only
            few = 1 if 1 <= apart < 8 else 0
            n1, n2 = -(-(apart + 1) // (few + 1)), 3 if few else 1
            n1 += n1 // 12 + 2 if apart else 0  # some parts more than needed, so that those with empty subsets can be done without
            self.plans[band] = n1, n2, list(combinations(range(n2), n2 - few)), n1 - apart // (few + 1)
        return self.plans[band]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """Two sets that are similar enough have one in common (of the instance of the smaller one's band)."""
        own = self.band(len(features))
        return np.concatenate([self._instance(features, b) for b in ((own - 1, own) if own else (own,))])

    def _instance(self, features: np.ndarray, band: int) -> np.ndarray:
        n1, n2, subsets, equal = self.plan(band)
        cell = (mixed(features + np.uint64(band)) >> np.uint64(33)) % np.uint64(n1 * n2)
        spread = mixed(features ^ np.uint64(0xA24BAED4963EE407))
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, cell.astype(np.int64), spread)  # a set's hash: the sum of its members', modulo 2**64
        total = total.reshape(n1, n2)
        there = np.bincount(cell.astype(np.int64), minlength=n1 * n2).reshape(n1, n2)
        there = np.stack([there[:, list(s)].any(axis=1) for s in subsets])
        if np.count_nonzero(~there.all(axis=0)) >= equal:  # all the parts with an equal subset might be among those
            there[:] = True
        first = np.arange(n1, dtype=np.uint64) * np.uint64(len(subsets))
        out = [mixed(mixed(total[:, list(s)].sum(axis=1, dtype=np.uint64)) + (first + np.uint64(i)) + (np.uint64(band) << np.uint64(40))) for i, s in enumerate(subsets)]
        return np.concatenate(out)[there.ravel()]


def _sets(df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """(id, tag, n, key, sketch, sigs): hash of the text, size and 128-bit key of each set, and its sketch and signatures where a task sees the set
    first. key is null for sets that take no part."""

    def run(batches):
        plan, seen = PartEnum(num, den), set()
        for part, texts in text_batches(batches, 1):
            sizes, keys, sketches, sigs = [], [], [], []
            for i, t in zip(part.column(0).is_valid().to_pylist(), texts, strict=True):
                s = shingle_set(t, n)
                sizes.append(len(s))
                key = set_key(s) if len(s) and i else None
                keys.append(key)
                new = key and key not in seen
                sketches.append(sketch(s) if new else None)
                sigs.append(plan.signatures(s) if new else s[:0])
                seen.add(key)
            ends = pa.array(np.cumsum([0, *map(len, sigs)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sigs).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), lists], ["id", "tag", "n", "key", "sketch", "sigs"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_tag(F.col(text_col)).alias("tag"))
    return rows.mapInArrow(run, f"id {kind}, tag binary, n long, key binary, sketch binary, sigs array<long>")


def text_tag(text: Column) -> Column:
    """128 bits of a text; null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def set_key(features: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(features.tobytes())


def sketch(features: np.ndarray) -> bytes:
    """Parity of the features that hash to each of about as many bits (a power of two, 64 at least)."""
    bits = max(64, 1 << round(np.log2(len(features))))
    at = np.bincount((features & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def linked_components(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                      block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links of similarity num / den or more)."""
    found = linked_rows(df, n, num, den, id_col, text_col, block_shingles)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def linked_rows(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, tag, n, component, root) for each row: tag tells rows that share an id apart by their texts, root components that share a smallest id;
    it is null for rows that take no part."""
    signed, path = written_at(_sets(df, id_col, text_col, n, num, den), "jaccard-sets")
    groups = _shared_signatures(signed)
    sets = written(signed.drop("sigs"), "jaccard-keys")
    remove(df.sparkSession, path)
    classes = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    labels = _labels(df, sets, classes, groups, n, num, den, id_col, text_col, block_shingles)
    labelled = classes.join(labels, "key", "left").select("key", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "key").alias("root"))
    found = sets.select("id", "tag", "n", "key").where("key IS NOT NULL").join(labelled, "key").select("id", "tag", "n", "component", "root")
    return found.union(sets.where("key IS NULL").select("id", "tag", "n", F.col("id").alias("component"), F.col("key").alias("root")))


def _shared_signatures(sets: DataFrame) -> DataFrame:
    """(g, k): the classes k (64 bits of the key) of each signature that several share; signatures of the same classes count once."""
    rows = sets.select(F.explode("sigs").alias("sig"), F.xxhash64("key").alias("k")).repartition("sig").groupBy("sig", "k").agg(F.lit(1).alias("one"))
    own = Window.partitionBy("sig")
    shared = rows.select(
        "k", F.min("k").over(own).alias("lo"), F.max("k").over(own).alias("hi"), F.count("one").over(own).alias("m"),
        F.bit_xor(F.xxhash64("k")).over(own).alias("x"),
    ).where("lo <> hi")
    return written(shared.select(F.xxhash64("m", "x", "lo", "hi").alias("g"), "k").distinct(), "jaccard-groups")


def _labels(df, sets, classes, groups, n, num, den, id_col, text_col, block_shingles) -> DataFrame:
    """(key, component, root) of the classes that share signatures with others."""
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("k").alias("first"))
    beside = groups.join(sizes, "g")
    score = beside.groupBy("k").agg(F.sum("m").alias("score"))
    clusters = components(written(_near(beside, sets, num, den), "jaccard-near"))
    in_cluster = clusters.select(F.col("node").alias("k"), F.col("root").alias("cluster")).join(score, "k")
    chosen = written(classes.withColumn("k", F.xxhash64("key")).join(in_cluster, "k").drop("k"), "jaccard-classes")
    blocks = chosen.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks"))
    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    placed = chosen.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("key", F.lit(7)), "blocks"))
    # Merged at every size: members may be few enough to broadcast in a small corpus, but they grow with it.
    members = written(placed.hint("merge").join(texts.hint("merge"), "rep"), "jaccard-members")
    # A large cluster's members that share most signatures, the likely centres of its copies, are put before each of its blocks.
    best = Window.partitionBy("cluster").orderBy(F.desc("score"), "key")
    centres = chosen.join(blocks.where("blocks > 1"), "cluster").withColumn("r", F.row_number().over(best)).where(F.col("r") <= CENTRES).select("key")
    spread = members.join(centres, "key", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["cluster", "block", "key", "score", "text"]
    side = F.lit(None).cast("binary").alias("part"), F.lit(True).alias("asks")
    links = written(_links(members.select(*columns, *side).union(spread.select(*columns, *side)), ["cluster", "block"], n, num, den), "jaccard-links")
    if not blocks.where("blocks > 1").isEmpty():
        links = links.union(_remaining(members.where("blocks > 1"), links, n, num, den, block_shingles))
    roots = components(links)
    named = chosen.join(roots, chosen["key"] == roots["node"]).select("key", "rep", "root")
    return named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root").select("key", "component", "root")


def _near(beside: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): classes of a signature whose sketches do not rule out that they are similar, as links that join what was apart in it."""
    own = sets.where("sketch IS NOT NULL").groupBy(F.xxhash64("key").alias("k")).agg(F.min("n").alias("n"), F.max("n").alias("most"), F.first("sketch").alias("sketch"))
    own = own.select("k", "n", F.when(F.col("n") == F.col("most"), F.col("sketch")).alias("sketch"))  # two classes of one k are not told apart
    rows = beside.where(F.col("m") <= SKETCHED).select("g", "k").hint("merge").join(own.hint("merge"), "k").select("g", "k", "n", "sketch")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            g = table.column("g").to_numpy()
            ends = [*(np.flatnonzero(g[1:] != g[:-1]) + 1)]
            yield from near_links(table.slice(0, ends[-1] if ends else 0), ends, num, den)
            held = table.slice(ends[-1] if ends else 0)
        if held is not None:
            yield from near_links(held, [held.num_rows], num, den)

    near = rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")
    return near.union(beside.where(F.col("m") > SKETCHED).select(F.col("k").alias("a"), F.col("first").alias("b"))).where("a <> b").distinct()


def near_links(table: pa.Table, ends: list[int], num: int, den: int):
    """One batch of links for the rows, whose signatures end at the given places."""
    k, n, sketches = table.column("k").to_numpy(), table.column("n").to_numpy(), table.column("sketch").to_pylist()
    a, b, start = [], [], 0
    for end in ends if table.num_rows else []:
        for i, j in alike(n[start:end], sketches[start:end], num, den):
            a.append(k[start + i])
            b.append(k[start + j])
        start = end
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def alike(sizes: np.ndarray, sketches: list[bytes | None], num: int, den: int) -> list[tuple[int, int]]:
    """Links among sets whose sizes and sketches allow a similarity of num / den, one for each two parts that they join."""
    if None in sketches:
        return [(0, i) for i in range(1, len(sizes))]
    least = min(map(len, sketches))  # a sketch of more bits folds into one of half as many
    rows = np.empty((len(sizes), least // 8), np.uint64)
    for i, s in enumerate(sketches):
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(s, "<u8").reshape(-1, least // 8), axis=0)
    part, links = np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        after = np.flatnonzero((part[i + 1 :] != part[i]) & (den * sizes[i + 1 :] >= num * sizes[i]) & (num * sizes[i + 1 :] <= den * sizes[i])) + i + 1
        if not len(after):
            continue
        apart = np.bitwise_count(rows[after] ^ rows[i]).sum(axis=1, dtype=np.int64)
        for j in after[apart * (num + den) <= (den - num) * (sizes[after] + sizes[i])].tolist():
            if part[j] != part[i]:
                links.append((i, j))
                part[part == part[j]] = part[i]
    return links


def _remaining(members: DataFrame, links: DataFrame, n: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """Links of what the first round left apart from the largest part of its cluster, sought in all blocks of that cluster."""
    roots = components(links)
    known = written(members.join(roots, members["key"] == roots["node"], "left").select(members["*"], F.coalesce("root", "key").alias("part")), "jaccard-parts")
    parts = known.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("cluster").agg(F.max_by("part", F.struct("m", "part")).alias("main"))
    left = known.join(main, "cluster").where("part <> main").drop("main")
    pieces = left.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).alias("pieces"))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    asking = left.join(pieces, "cluster").withColumn("piece", F.pmod(F.xxhash64("key", F.lit(11)), "pieces")).withColumn("block", every("blocks"))
    asked = known.join(pieces, "cluster").withColumn("piece", every("pieces"))
    columns = ["cluster", "block", "piece", "key", "score", "text", "part"]
    both = asking.select(*columns, F.lit(True).alias("asks")).union(asked.select(*columns, F.lit(False).alias("asks")))
    return _links(both, ["cluster", "block", "piece"], n, num, den)


def _links(rows: DataFrame, by: list[str], n: int, num: int, den: int) -> DataFrame:
    """(a, b): keys of similar sets that join what was apart, within each task's rows. Rows that ask are compared with all."""

    def run(table: pa.Table) -> pa.Table:
        held: dict[bytes, tuple] = {}
        for key, score, text, part, asks in zip(*(table.column(c).to_pylist() for c in ("key", "score", "text", "part", "asks")), strict=True):
            features = held[key][3] if key in held else shingle_set(text, n)
            if key in held or set_key(features) == key:  # another text under the same id has another key
                held[key] = asks or key in held and held[key][0], score, part or key, features
        keys = sorted(held, key=lambda k: (-held[k][1], k))
        found = local_links([held[k][3] for k in keys], [held[k][2] for k in keys], [held[k][0] for k in keys], num, den)
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.binary()), "b": pa.array([keys[j] for _, j in found], pa.binary())})

    return rows.groupBy(*by).applyInArrow(run, "a binary, b binary")


def local_links(sets: list[np.ndarray], parts: list, asks: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Links among the sets, one for each two parts that they join. Pairs already in one part are not compared."""
    sizes = np.array(list(map(len, sets)))
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else ([], np.empty(0, np.int64))
    part = np.unique(np.array([bytes(p) for p in parts], object), return_inverse=True)[1] if sets else np.empty(0)
    mark, asks, done, links = np.zeros(len(vocabulary), bool), np.array(asks, bool), np.zeros(len(sets), bool), []
    for i in range(len(sets)):
        if not asks[i]:
            continue
        done[i] = True
        near = (part != part[i]) & ~done & (den * sizes >= num * sizes[i]) & (num * sizes <= den * sizes[i])
        if not near.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        linked = np.flatnonzero(near & (den * common >= num * (sizes + sizes[i] - common)))
        for p, j in {int(part[j]): int(j) for j in linked}.items():
            links.append((i, j))
            part[part == p] = part[i]
    return links
