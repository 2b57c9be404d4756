r"""Fuzzy line deduplication by MinHash. DataFrame and SQL functions only.

Distinct trimmed lines get signatures from the shingles that also decide: all runs of n characters. One hash of a run deals it to one of CLASSES
classes; each class gives MASKS minima of its hashes (each xor a constant). A band is a minimum of each of ROWS classes (fewer for thresholds below
0.8), which are drawn anew for each constant, so that there are two bands for each; a class without runs takes no part. For sets of Jaccard similarity J
a band agrees with a probability of about J ** ROWS, whatever the edits are. Lines of few runs (up to WHOLE occupied cells of the sketch) have a key for
each whole class besides: at 0.8 the runs that only one of two similar lines has are at most a ninth of both sets' sizes, so where that is less than
CLASSES one class is the same in both, and no such pair is lost (but for keys that happen to be 0, one in 2 ** 32).

Lines that share a band are candidates. Each line of a bucket is compared with the bucket's first line; what this leaves apart in a
bucket is then joined with all the bucket's lines, in blocks of bounded size; pairs already in one component are skipped. Before two sets are built,
their parity sketches are compared: a cell tells whether an odd number of a line's distinct runs fall on it. What both lines have cancels out, so two
sketches differ in no more cells than there are runs that only one of the lines has: no similar pair is lost, and few others are left. Only lines that
share a bucket are sketched, from their texts. Of the pairs left, the closest by sketch are verified first, and the others only where that leaves their
parts apart. The Jaccard similarity of the sets of all runs of n characters decides, each run by a 64-bit hash; distributed union-find joins what is
similar; the first line of a component stays. Lines are told apart by two 64-bit hashes.

One changed character inside a line breaks n runs of n characters on each side, so at 0.8 it is found in lines of 10 n - 1 characters or more: 49 with the
SHINGLE of 5, 29 with n=3. Shorter lines are found only if the change is near an end.

No window runs over a bucket; a line with any number of copies is one row from the first shuffle on. Bands move in PARTS, one after another, which
bounds the disk that their shuffles take.

Defined results: null and empty texts have one blank line; blank lines are kept and never compared; a line shorter than a shingle is one shingle; of
equal places (repeated rows) each keeps its first line. A null id sorts first. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import components, remove, written, written_at

SHINGLE, SIMILARITY = 5, 0.8
CLASSES, ROWS, MASKS, TURNS, WHOLE = 12, 6, 18, 18, 80
#: 64-bit words of a parity sketch.
WORDS = 16
#: Parts that the bands move in.
PARTS = 6
#: Characters in a block of a bucket.
BLOCK_CHARACTERS = 100_000

_KEY = ["_a", "_z"]
_random = random.Random(11)
_MASKS = [_random.getrandbits(64) - 2**63 for _ in range(MASKS)]
#: Orders of the classes, each for a mask: the first ROWS make a band, the others a second.
_TURNS = [_random.sample(range(CLASSES), CLASSES) for _ in range(TURNS)]


def _wide(line: Column) -> Column:
    """The line, upper and lower case alike, with four bytes for each character."""
    return F.encode(F.lower(line), "UTF-32")


def _many(wide: Column, n: int) -> Column:
    """How many runs of n characters begin in a line; a shorter line is one."""
    return F.greatest((F.octet_length(wide) / 4).cast("int") - (n - 1), F.lit(1))


def _hash(wide: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.substring(wide, at * 4 + 1, F.lit(4 * n)))


def runs(line: Column, n: int) -> Column:
    """64-bit hashes of the distinct runs of n characters, upper and lower case alike; a shorter line is one."""
    of = F.transform(F.array(_wide(line)), lambda u: F.array_distinct(F.transform(F.sequence(F.lit(0), _many(u, n) - 1), lambda i: _hash(u, i, n))))
    return of[0]


def similar(a: Column, b: Column, share: Fraction) -> Column:
    """Whether the Jaccard similarity of two arrays of distinct values reaches the share."""
    return F.size(F.array_intersect(a, b)) * (share.numerator + share.denominator) >= (F.size(a) + F.size(b)) * share.numerator


def rows_of(share: Fraction) -> int:
    """Rows of a band: as many as let a pair at the threshold agree in a band with a probability of 0.26 or more, which ROWS do at 0.8."""
    return ROWS if share >= 1 else max(1, min(ROWS, int(math.log(0.26) / math.log(max(share, 0.01)))))


def _odd(x: Column, y: Column) -> Column:
    """The cells that only one of two sketches has."""
    return sum((F.bit_count(x[f"w{c}"].bitwiseXOR(y[f"w{c}"])) for c in range(1, WORDS)), F.bit_count(x["w0"].bitwiseXOR(y["w0"])))


def may_be_similar(x: Column, y: Column, share: Fraction) -> Column:
    """Whether two sketched sets, structs of (n: their size, w0, w1, ...), may reach the share; true of all that do."""
    num, den = share.numerator, share.denominator
    # Of sizes that sum up to t, a similarity of num / den leaves t (den - num) / (den + num) runs to one side alone.
    return _odd(x, y) * (num + den) <= (x["n"] + y["n"]) * (den - num)


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _no, _blank, _line, _a, _z): all lines, with white space collapsed where there is any to collapse, and two hashes as their key."""
    placed = df.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_no", "_raw"))
    odd = F.col("_raw").contains("  ")
    for c in "\t\r\f\v":
        odd = odd | F.col("_raw").contains(c)
    lines = placed.select("_id", "_no", (~F.col("_raw").rlike(r"\S")).alias("_blank"), F.trim(F.when(odd, F.regexp_replace("_raw", r"\s+", " ")).otherwise(F.col("_raw"))).alias("_line"))
    return lines.select("*", *[F.xxhash64(F.lit(k), "_line").alias(k) for k in _KEY])


def line_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = SHINGLE,
                    block_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """One row per line of each text: id, line_no (from 0), kept, first_id and first_line_no (the place of the line that stays for it)."""
    share = Fraction(similarity).limit_denominator(10_000)
    placed = _lines(df, id_col, text_col)
    keyed = placed.where("NOT _blank").select(*_KEY, "_line")
    signed, path = written_at(_signed(keyed, share, n), "line-signatures")
    lines = written(signed.select("_l", *_KEY), "lines")
    buckets = _buckets(signed)
    remove(df.sparkSession, path)
    wanted = lines.hint("merge").join(buckets.select("_l").distinct().hint("merge"), "_l")
    # The texts of lines that share a bucket with others: a task's copies of a line are combined before they move.
    texts = written(keyed.hint("merge").join(wanted.hint("merge"), _KEY).select("_l", "_line").distinct(), "line-texts")
    sketched = written(_sketched(texts, n), "line-sketches")
    roots = _star(buckets, texts, sketched, share, n)
    roots = _remaining(texts, buckets, sketched, roots, share, n, block_characters)
    named = lines.join(roots, lines["_l"] == roots["node"], "left").select(*_KEY, F.coalesce("root", "_l").alias("_root"))
    at = written(placed.select("_id", "_no", "_blank", *_KEY), "line-keys")
    places = written(at.where("NOT _blank").join(named, _KEY).select("_id", "_no", "_root"), "line-places")
    first = places.groupBy("_root").agg(F.min(F.struct("_id", "_no")).alias("_first"))
    found = places.join(first, "_root").select("_id", "_no", F.col("_first._id").alias("_fid"), F.col("_first._no").alias("_fno"))
    blank = at.where("_blank").select("_id", "_no", F.col("_id").alias("_fid"), F.col("_no").alias("_fno"))
    kept = F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_no") == F.col("_fno"))
    return found.union(blank).select(F.col("_id").alias(id_col), F.col("_no").alias("line_no"), kept.alias("kept"), F.col("_fid").alias("first_id"), F.col("_fno").alias("first_line_no"))


def _signed(keyed: DataFrame, share: Fraction, n: int) -> DataFrame:
    """(_l, _a, _z, x0, x1, ..., v0, v1, ...): a number for each distinct line, its bands and whole classes, two to a number."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # All that follows stays where a line's key has put it.
    lines = keyed.repartition(parts, *_KEY).distinct()
    sized = lines.select(*_KEY, _wide(F.col("_line")).alias("_u")).select("*", _many(F.col("_u"), n).alias("_n"))
    hashes = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i")).select(*_KEY, "_n", _hash(F.col("_u"), F.col("_i"), n).alias("_h"))
    # The class comes from the upper half of a hash, the cell from its last bits.
    dealt = hashes.select("*", F.expr(f"CAST(shiftrightunsigned(shiftrightunsigned(_h, 32) * {CLASSES}L, 32) AS INT)").alias("_c"), F.expr("shiftleft(1L, CAST(_h & 63 AS INT))").alias("_cell"))
    least = [F.min(F.col("_h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(_MASKS)]
    classes = dealt.groupBy(*_KEY, "_n", "_c").agg(F.bit_or("_cell").alias("_o"), *least)
    # Each class's share of its bands: of the two bands of a number one has the upper 32 bits, the other the lower.
    most = rows_of(share)
    taken = lambda classes: f"(shiftright({sum(1 << c for c in classes)}, _c) & 1) = 1"
    half = lambda t: F.expr(f"CASE WHEN {taken(t[:most])} THEN {-(1 << 32)}L WHEN {taken(t[ROWS : ROWS + most])} THEN {(1 << 32) - 1}L ELSE 0L END")
    shares = [F.xxhash64("_c", f"m{i % MASKS}").bitwiseAND(half(t)).alias(f"x{i}") for i, t in enumerate(_TURNS)]
    whole = F.xxhash64("_o", *[f"m{i}" for i in range(MASKS)]).bitwiseAND(F.expr(f"IF(_c % 2 = 1, {-(1 << 32)}L, {(1 << 32) - 1}L)"))
    mixed = classes.select(*_KEY, "_n", "_c", "_o", whole.alias("_w"), *shares)
    none = F.lit(0).cast("long")
    bands = [F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(len(_TURNS))]
    cells = [F.bit_or(F.when(F.col("_c") == c, F.col("_o")).otherwise(none)).alias(f"w{c}") for c in range(CLASSES)]
    wholes = [F.bit_or(F.when(F.expr(f"_c div 2 = {c}"), F.col("_w")).otherwise(none)).alias(f"v{c}") for c in range(-(-CLASSES // 2))]
    signed = mixed.groupBy(*_KEY, "_n").agg(*bands, *cells, *wholes)

    occupied = sum((F.bit_count(f"w{c}") for c in range(1, CLASSES)), F.bit_count("w0"))
    few = [F.when(occupied <= WHOLE, F.col(f"v{c}")).otherwise(none).alias(f"v{c}") for c in range(-(-CLASSES // 2))]
    return signed.select(F.monotonically_increasing_id().alias("_l"), *_KEY, *[f"x{i}" for i in range(len(_TURNS))], *few)


def _sketched(texts: DataFrame, n: int) -> DataFrame:
    """(_l, _sk): how many distinct runs each line has, and their parity sketch. A line's runs are combined in the task that has its text."""
    none = F.lit(0).cast("long")
    hashes = texts.select("_l", F.explode(runs(F.col("_line"), n)).alias("_h"))
    # The word comes from a hash's first four bits, the cell from its last six.
    dealt = hashes.select("_l", F.expr("shiftrightunsigned(_h, 60)").alias("_c"), F.expr("shiftleft(1L, CAST(_h & 63 AS INT))").alias("_cell"))
    words = [F.bit_xor(F.when(F.col("_c") == c, F.col("_cell")).otherwise(none)).alias(f"w{c}") for c in range(WORDS)]
    sketches = dealt.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), *words)
    return sketches.select("_l", F.struct("n", *[f"w{c}" for c in range(WORDS)]).alias("_sk"))


def _keys(x: str) -> list[Column]:
    """The keys of a number's halves; where none of a half's classes has runs, there is none."""
    halves = F.col(x).bitwiseAND(F.lit(-(1 << 32))), F.col(x).bitwiseAND(F.lit((1 << 32) - 1))
    return [F.when(h != 0, F.xxhash64(F.lit(x), F.lit(side), h)) for side, h in enumerate(halves)]


def _buckets(lines: DataFrame) -> DataFrame:
    """(_l, _b, _first, _size): the lines of the buckets that several share; of buckets of the same lines one."""
    parts, members = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    names = [*(f"x{i}" for i in range(len(_TURNS))), *(f"v{c}" for c in range(-(-CLASSES // 2)))]
    for p in range(PARTS):
        keys = F.array(*[k for x in names[p::PARTS] for k in _keys(x)])
        rows = lines.select("_l", F.explode(keys).alias("_b")).where("_b IS NOT NULL").repartition(parts, "_b")
        shared = rows.groupBy("_b").agg(F.min("_l").alias("_first"), F.max("_l").alias("_last")).where("_first < _last")
        members.append(written(rows.join(shared.hint("shuffle_hash"), "_b"), "line-members"))
    members = reduce(DataFrame.union, members)
    kinds = members.groupBy("_b").agg(F.min("_first").alias("_first"), F.min("_last").alias("_last"), F.count(F.lit(1)).alias("_size"), F.bit_xor(F.xxhash64("_l")).alias("_x"))
    once = kinds.groupBy("_first", "_last", "_size", "_x").agg(F.min("_b").alias("_b")).select("_b", "_size")
    return written(members.join(once, "_b").select("_l", "_b", "_first", "_size"), "line-buckets")


def _verified(pairs: DataFrame, texts: DataFrame, share: Fraction, n: int) -> DataFrame:
    """The pairs (a, b, ...) of lines that are similar."""
    side = lambda k, x: texts.select(F.col("_l").alias(k), F.col("_line").alias(x)).hint("merge")
    both = pairs.hint("merge").join(side("b", "_y"), "b").hint("merge").join(side("a", "_x"), "a")
    sets = F.array(F.struct(runs(F.col("_x"), n).alias("x"), runs(F.col("_y"), n).alias("y")))
    return both.where(F.exists(sets, lambda s: similar(s["x"], s["y"], share))).select(*pairs.columns)


def _linked(roots: DataFrame | None, pairs: DataFrame, each: list[str], texts: DataFrame, share: Fraction, n: int, name: str) -> DataFrame:
    """(node, root) with the parts _p and _q joined of all pairs of lines (_p, _q, a, b, _odd) that are similar.

    The closest pair of each part (or two parts) goes first; the others are verified where that leaves their parts apart.
    """
    link = lambda found: written(found.select(F.col("_p").alias("a"), F.col("_q").alias("b")).distinct(), name)
    closest = pairs.groupBy(*each).agg(F.min(F.struct("_odd", "_p", "_q", "a", "b")).alias("e")).select("e.*").drop("_odd")
    first = link(_verified(closest, texts, share, n))
    after = _joined(roots, first) if roots else components(first)
    others = pairs.drop("_odd").join(closest, closest.columns, "left_anti")
    for end in ("_p", "_q"):
        now = after.select(F.col("node").alias(end), F.col("root").alias("_root"))
        others = others.join(now, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    return _joined(after, link(_verified(others.where("_p <> _q").select(closest.columns), texts, share, n)))


def _star(buckets: DataFrame, texts: DataFrame, sketched: DataFrame, share: Fraction, n: int) -> DataFrame:
    """(node, root): lines that are similar to the first one of a bucket of theirs, joined."""
    pairs = buckets.where("_l <> _first").select(F.col("_l").alias("a"), F.col("_first").alias("b")).distinct()
    shape = lambda k, x: sketched.select(F.col("_l").alias(k), F.col("_sk").alias(x)).hint("merge")
    drawn = pairs.hint("merge").join(shape("b", "_t"), "b").hint("merge").join(shape("a", "_s"), "a")
    maybe = drawn.where(may_be_similar(F.col("_s"), F.col("_t"), share))
    close = written(maybe.select(F.col("a").alias("_p"), F.col("b").alias("_q"), "a", "b", _odd(F.col("_s"), F.col("_t")).alias("_odd")), "line-near")
    return _linked(None, close, ["_p"], texts, share, n, "line-links")


def _remaining(texts: DataFrame, buckets: DataFrame, sketched: DataFrame, roots: DataFrame, share: Fraction, n: int, block_characters: int) -> DataFrame:
    """(node, root) after lines of a bucket that are similar but not yet in one component are joined. Buckets of two have been compared."""
    own = buckets.where("_size > 2").join(roots, F.col("_l") == F.col("node"), "left").select("_l", "_b", F.coalesce("root", "_l").alias("_part"))
    parts = written(own, "line-parts")
    # What is similar to the first line is in its part; lines outside that part have not met each other, and met no other line of it.
    apart = parts.groupBy("_b").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).where("lo <> hi").select("_b")
    known = written(parts.join(apart, "_b").join(sketched.select("_l", "_sk").hint("merge"), "_l"), "line-apart")
    most = known.groupBy("_b", "_part").agg(F.count(F.lit(1)).alias("m")).groupBy("_b").agg(F.max_by("_part", F.struct("m", "_part")).alias("_main"))
    size = F.ceil(F.sum("_sk.n") / block_characters)
    blocks = known.groupBy("_b").agg(size.alias("_blocks"))
    left = known.join(most, "_b").where("_part <> _main").drop("_main")
    pieces = left.groupBy("_b").agg(size.alias("_pieces"))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    keys, row = ["_b", "_block", "_piece"], ["_l", "_part", "_sk"]
    named = lambda df, x: df.select(*keys, *[F.col(c).alias(x + c) for c in row]).hint("merge")
    asking = left.join(blocks, "_b").join(pieces, "_b").withColumn("_piece", F.pmod(F.xxhash64("_l", F.lit(11)), "_pieces")).withColumn("_block", every("_blocks"))
    asked = known.join(blocks, "_b").join(pieces, "_b").withColumn("_block", F.pmod(F.xxhash64("_l", F.lit(7)), "_blocks")).withColumn("_piece", every("_pieces"))
    close = named(asking, "x").join(named(asked, "y"), keys).where("x_part <> y_part").where(may_be_similar(F.col("x_sk"), F.col("y_sk"), share))
    a, b = (F.struct(F.col(f"{x}_part").alias("part"), F.col(f"{x}_l").alias("l")) for x in "xy")
    ends = close.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), _odd(F.col("x_sk"), F.col("y_sk")).alias("_odd"))
    pairs = written(ends.select("a.part", "b.part", "a.l", "b.l", "_odd").toDF("_p", "_q", "a", "b", "_odd").distinct(), "line-close")
    return _linked(roots, pairs, ["_p", "_q"], texts, share, n, "line-remaining")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with the links (a, b) between roots added; a line that was alone is its own root."""
    if links.isEmpty():
        return roots
    after = components(links).select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    alone = after.join(roots, F.col("_old") == F.col("node"), "left_anti").select(F.col("_old").alias("node"), F.col("_old").alias("root"))
    return roots.union(alone).join(after, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root"))
