"""Language-model scoring by a probabilistic suffix tree over words.

Nodes are contexts of one to DEPTH words that occur LEAST times or more in training documents, however large the corpus, and whose next-symbol
distribution diverges enough from that of their suffix; the suffixes of a node are nodes. Symbols are the words that occur LEAST times or more and
one for all others, inside which a word has its share by the base model. A node's distribution is smoothed by absolute discounting towards its
suffix's, the root is the base model, so the probabilities of all words, unknown ones together as one, sum to 1. A token is scored by the node of the
longest retained suffix of the words before it.

Texts become blocks of tokens once. Words have 64-bit keys, dealt by their upper bits to parts that count them and number the symbols, frequent ones first: a table of the distinct counts, fewer than the square root of twice
the tokens, then tells each symbol's count. Then every token
with a context becomes a row (words before it, nearest first; symbol; document), and the rows are sorted into ranges of about RANGE_TOKENS rows: in
this order all occurrences of a context, and of all longer ones that end in it, are next to each other, so a range counts, tests and scores its own
part of the tree and returns sums for each document. Bounds come from a sample of rows and are moved back to the start of a context where that is near.
Only contexts larger than a range are cut by bounds ("open": at most DEPTH for each bound); their symbols are counted by parts that share no symbol,
and each range gets the counts of the symbols that it has. A key of any share of the rows is cut too, as blocks are part of the order. No task holds
more than a block, a part or a range; the driver holds bounds and open contexts, a few numbers for each range. A block sends one record to each
range that it has rows of, so records grow short where ranges are far more than a block's distinct contexts.

Defined results: a null or empty text is its end token alone; a null id is a training document; repeated rows are counted and scored each; without
training documents all counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, mixed, remove, written, written_at
from .bpe import text_batches

#: Least training occurrences of a context and of a symbol of its own; least divergence (nats for each occurrence) of a retained context.
LEAST, DIVERGENCE = 3, 0.02
#: Most words of a context.
DEPTH = 3
#: Absolute discount; tokens in a block (a longer document is a block of its own); rows in a range.
DISCOUNT, BLOCK_TOKENS, RANGE_TOKENS = 0.75, 400_000, 300_000
#: Parts of the words (a power of two): so many at least, and more where a part would have those of more blocks than this.
PARTS, PART_BLOCKS = 64, 20
#: Rows of the sample that bounds are taken from, for each range.
SAMPLED = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MEMO = WordHashes()
#: The end token: not the hash of any word, as words hash to 64-bit values of which this one is set aside.
END = np.uint64(0x0E0D0E0D0E0D0E0D)


def tokens(text: str) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, between ASCII white space), then the end token."""
    return np.r_[_MEMO.of(text.encode().translate(_LOWER).split()), END]


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def packed(*columns: np.ndarray) -> bytes:
    """Unsigned 32-bit columns of one length, byte plane by byte plane, compressed: the upper planes and what is sorted nearly vanish."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns))


def unpacked(data: bytes, columns: int = 1) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0]


def blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokens of some documents as indices into their distinct words (ascending hashes)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        part, k, docs, size = pyspark.TaskContext.get().partitionId(), 0, [], 0

        def flush():
            words, at = np.unique(np.concatenate([h for _, _, h in docs]), return_inverse=True)
            row = {"block": part << 32 | k, "words": words.tobytes(), "at": packed(at), "ids": [i for i, _, _ in docs], "held": [x for _, x, _ in docs], "lengths": [len(h) for _, _, h in docs]}
            return pa.RecordBatch.from_pydict({n: pa.array([x], t) for (n, x), t in zip(row.items(), (pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int64())), strict=True)})

        for batch, texts in text_batches(batches, 1):
            id_type = batch.column(0).type
            for i, x, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
                h = tokens(t)
                if docs and size + len(h) > block_tokens:
                    yield flush()
                    k, docs, size = k + 1, [], 0
                docs.append((i, x, h))
                size += len(h)
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (held_out(id_col) if held is None else held).alias("held"))
    return rows.mapInArrow(run, f"block long, words binary, at binary, ids array<{kind}>, held array<boolean>, lengths array<long>")


def _rows(table: pa.Table, *names: str):
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)


def _binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


def _word_requests(cut: DataFrame, count: int) -> DataFrame:
    """Each block's distinct words with its training counts, a record for each part."""

    def run(batches):
        for batch in batches:
            for block, words, at, lengths, held in _rows(batch, "block", "words", "at", "lengths", "held"):
                keys = np.frombuffer(words, np.uint64)
                trained = np.repeat(~np.array(held, bool), lengths)
                counts = np.bincount(unpacked(at)[0][trained], minlength=len(keys))
                ends = np.r_[0, np.searchsorted(keys >> np.uint64(65 - count.bit_length()), np.arange(count), "right")]
                parts = [p for p in range(count) if ends[p] < ends[p + 1]]
                cut = [slice(ends[p], ends[p + 1]) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([block] * len(parts), pa.int64()), _binary([keys[c].tobytes() for c in cut]), _binary([packed(counts[c]) for c in cut])], ["part", "block", "keys", "counts"])

    return cut.select("block", "words", "at", "lengths", "held").mapInArrow(run, "part long, block long, keys binary, counts binary")


def _count_words(table: pa.Table, least: int) -> pa.Table:
    """To each block the training counts of its keys of a part, and their numbers among the part's symbols of the same count (from 0). And the part's
    training tokens and distinct words, and how many symbols have each count."""
    table = table.sort_by("block")
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    flat, ends = np.concatenate(keys), np.cumsum(list(map(len, keys)))
    distinct, at = np.unique(flat, return_inverse=True)
    c = np.bincount(at, np.concatenate([unpacked(x)[0] for x in table.column("counts").to_pylist()]), len(distinct)).astype(np.int64)
    order = np.argsort(c, kind="stable")
    number, starts = np.empty(len(c), np.int64), np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
    number[order] = np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
    values, sizes = np.unique(c[c >= least], return_counts=True)
    split, none = [slice(e - len(k), e) for e, k in zip(ends, keys, strict=True)], [None] * (len(keys) - 1)
    return pa.table({"block": table.column("block"), "part": table.column("part"), "counts": _binary([packed(c[at[s]], c[at[s]] >> 32) for s in split]), "numbers": _binary([packed(np.where(c[at[s]] >= least, number[at[s]], 0)) for s in split]),
                     **{n: pa.array([int(x), *none], pa.int64()) for n, x in (("tokens", c.sum()), ("words", (c > 0).sum()))}, **{n: _binary([x.astype(np.int64).tobytes(), *none]) for n, x in (("values", values), ("sizes", sizes))}})


class Root:
    """The base model, and the numbers of symbols: frequent ones first, those of equal counts by part; 0 is all other words."""

    def __init__(self, figures: list, least: int):
        self.least, self.tokens, self.words = least, sum(r["tokens"] for r in figures), sum(r["words"] for r in figures)
        self.total, by_part = self.tokens + self.words + 1, {r["part"]: (np.frombuffer(r["values"], np.int64), np.frombuffer(r["sizes"], np.int64)) for r in figures}
        self.values = np.unique(np.concatenate([np.empty(0, np.int64), *(v for v, _ in by_part.values())]))[::-1]
        before = np.zeros(len(self.values), np.int64)  # symbols of the same count in the parts before
        self.of_part = {}
        for part in sorted(by_part):
            values, sizes = by_part[part]
            at = np.searchsorted(-self.values, -values)
            self.of_part[part] = values, at, before[at].copy()
            before[at] += sizes
        self.first = 1 + np.cumsum(before) - before
        if before.sum() >= 2**32 - 1:
            raise ValueError("more symbols than 32 bits number: raise least")
        self.other = max(1 - float(((self.values + 1) * before).sum()) / self.total, 1e-300)  # of all words that are no symbols of their own

    def symbols(self, part: int, counts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        values, at, before = self.of_part[part]
        out, own = np.zeros(len(counts), np.uint32), counts >= self.least
        k = np.searchsorted(values, counts[own])
        out[own] = self.first[at[k]] + before[k] + numbers[own]
        return out

    def of_symbols(self, symbol: np.ndarray) -> np.ndarray:
        """Probabilities of symbols."""
        out, own = np.full(len(symbol), self.other), symbol > 0
        out[own] = (self.values[np.searchsorted(self.first, symbol[own], "right") - 1] + 1.0) / self.total
        return out


def _numbered(cut: DataFrame, answers: DataFrame, root: Root, depth: int) -> DataFrame:
    """Blocks whose words are numbers of symbols, with a sample of their rows and, for each document, known tokens, base score and the part of the
    score that needs no context."""
    kind = cut.schema["ids"].dataType.simpleString()

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        ((number, at, ids, held, lengths),) = _rows(block, "block", "at", "ids", "held", "lengths")
        counts, symbols = [], []
        for part, c, s in sorted(_rows(answer, "part", "counts", "numbers")):
            low, high = unpacked(c, 2).astype(np.int64)
            counts.append(low | high << 32)
            symbols.append(root.symbols(part, counts[-1], unpacked(s)[0]))
        counts, symbols, i = np.concatenate(counts), np.concatenate(symbols), unpacked(at)[0]
        starts = np.cumsum(lengths) - lengths
        base = (counts + 1.0) / root.total
        alone = np.log10(np.where(symbols > 0, 1.0, base / root.other))[i]
        rows = Rows(symbols[i], np.array(lengths), depth)
        free = np.ones(len(i), bool)
        free[rows.at] = False
        alone[free] += np.log10(root.of_symbols(symbols))[i[free]]
        picked = np.random.default_rng(number).permutation(len(rows.at))[: len(rows.at) // 512 + 1]
        made = [c[picked] for c in rows.columns]
        add = lambda x: np.add.reduceat(x, starts)
        lists = [pa.array([add(x)]) for x in ((counts > 0)[i].astype(np.int64), np.log10(base)[i], alone)]
        return pa.table({"block": block.column("block"), "at": _binary([packed(symbols[i])]), "ids": block.column("ids"),
                         "held": block.column("held"), "lengths": block.column("lengths"), "n_known": lists[0], "base": lists[1], "alone": lists[2],
                         "rows": pa.array([len(rows.at)], pa.int64()), "picked": _binary([np.stack(made, axis=1).astype("<u4").tobytes()])})

    schema = f"block long, at binary, ids {kind}, held array<boolean>, lengths array<long>, n_known array<long>, base array<double>, alone array<double>, rows long, picked binary"
    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


class Rows:
    """The tokens of a block that have a context: their places, and columns of the words before them (0 ends a context), nearest first, and symbols."""

    def __init__(self, symbol: np.ndarray, lengths: np.ndarray, depth: int):
        n = len(symbol)
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        before = np.zeros(n, np.uint32)
        before[1:] = symbol[:-1]
        self.at = np.flatnonzero((place > 0) & (before > 0))
        place, self.columns = place[self.at], [before[self.at]]
        for d in range(2, depth + 1):
            w = np.where((place >= d) & (self.columns[-1] > 0), symbol[np.maximum(self.at - d, 0)], 0)
            self.columns.append(w.astype(np.uint32))
        self.columns.append(symbol[self.at])


def sort_keys(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The same order by fewer keys: two columns in each."""
    wide = [*columns, np.zeros(len(columns[0]), np.uint32)] if len(columns) % 2 else columns
    return [a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64) for a, b in zip(wide[::2], wide[1::2], strict=True)]


def cuts(keys: list[np.ndarray], salt: int, bounds: np.ndarray) -> np.ndarray:
    """Where the sorted rows of a block lie in the ranges: of each bound, how many rows come before it."""
    wanted = sort_keys([np.ascontiguousarray(bounds[:, i]) for i in range(bounds.shape[1] - 1)])
    low, high = np.searchsorted(keys[0], wanted[0], "left"), np.searchsorted(keys[0], wanted[0], "right")
    for j in np.flatnonzero(low < high):
        a, b = low[j], high[j]
        for key, w in zip(keys[1:], wanted[1:], strict=True):
            a, b = a + np.searchsorted(key[a:b], w[j], "left"), a + np.searchsorted(key[a:b], w[j], "right")
        low[j] = b if salt < bounds[j, -1] else a
    return low


def salt_of(block: int) -> int:
    return int(mixed(np.array([block], np.uint64))[0] >> np.uint64(33)) + 1


class Plan:
    """Bounds of the ranges (context, symbol, salt) and the contexts that they cut."""

    def __init__(self, sample: np.ndarray, ranges: int, depth: int):
        self.depth = depth
        sample = sample[np.lexsort(sample.T[::-1])]
        self.bounds, step = [], len(sample) / max(ranges, 1)
        for k in range(1, ranges):
            at = int(k * step)
            row, lo = sample[at], 0
            for length in range(1, sample.shape[1] + 1):  # the shortest beginning whose start is near
                lo += int(np.searchsorted(sample[lo : at + 1, length - 1], row[length - 1], "left"))
                if at - lo <= step / 2 or length == sample.shape[1]:
                    self.bounds.append((*row[:length].tolist(), *[0] * (sample.shape[1] - length)))
                    break
        self.bounds = np.array(sorted(set(self.bounds)), np.int64).reshape(-1, depth + 2)
        self.open: list[tuple[int, ...]] = sorted({tuple(b[:d].tolist()) for b in self.bounds for d in range(1, depth + 1) if b[:d].all() and b[d:].any()}, key=lambda s: (len(s), s))
        self.number = {s: k for k, s in enumerate(self.open)}
        self.levels = []  # of each depth: (open suffix's number << 32 | word) in ascending order, and the numbers
        for d in range(1, depth + 1):
            own = sorted((((self.number[s[:-1]] + 1 if d > 1 else 0) << 32 | s[-1]), k) for s, k in self.number.items() if len(s) == d)
            self.levels.append((np.array([x for x, _ in own], np.uint64), np.array([k for _, k in own], np.int64)))

    def numbers(self, columns: list[np.ndarray]):
        """Of each depth: the number of each row's context among the open ones, -1 for others."""
        up = np.full(len(columns[0]), -1)
        for d, (keys, own) in enumerate(self.levels):
            found = np.full(len(up), -1)
            if len(keys):
                there = np.arange(len(up)) if d == 0 else np.flatnonzero(up >= 0)
                wanted = (up[there] + 1).astype(np.uint64) << np.uint64(32) | columns[d][there]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found[there] = np.where(keys[at] == wanted, own[at], -1)
            yield found
            up = found


def _of_block(row, depth: int):
    """Sorted columns, keys and documents (twice the number, and 1 for training) of a block's rows."""
    block, symbols, held, lengths = row
    lengths = np.array(lengths)
    rows = Rows(unpacked(symbols)[0], lengths, depth)
    doc = np.repeat(np.arange(len(lengths)) * 2 + ~np.array(held, bool), lengths)[rows.at]
    keys = sort_keys(rows.columns)
    order = np.lexsort(keys[::-1])
    return [c[order] for c in rows.columns], [k[order] for k in keys], doc[order]


_BLOCK = ("block", "at", "held", "lengths")


def _open_requests(made: DataFrame, plan: Plan, count: int) -> DataFrame:
    """Training counts of the symbols after open contexts, by range; a record for each part (of symbols) and block."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch, *_BLOCK):
                columns, keys, doc = _of_block(row, plan.depth)
                ends = cuts(keys, salt_of(row[0]), plan.bounds)
                place = np.searchsorted(ends, np.arange(len(doc)), "right")
                found = []
                for number in plan.numbers(columns):
                    on = np.flatnonzero(number >= 0)
                    found.append(np.stack([columns[-1][on].astype(np.int64), number[on], place[on], doc[on] & 1]))
                rows = np.concatenate(found, axis=1)
                if not rows.shape[1]:
                    continue
                rows = rows[:, np.lexsort(rows[:3])]
                new = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
                rows = np.concatenate([rows[:3, new], np.add.reduceat(rows[3], new)[None]])
                part = (mixed(rows[0].astype(np.uint64)) % np.uint64(count)).astype(np.int64)
                for p in np.unique(part).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), _binary([rows[:, part == p].tobytes()])], ["part", "rows"])

    return made.select(*_BLOCK).mapInArrow(run, "part long, rows binary")


def _count_open(table: pa.Table, plan: Plan, root: Root) -> pa.Table:
    """To each range the counts of its symbols after open contexts (range, context, symbol, count), and as range -1 summands of each context's
    figures: occurrences, distinct symbols, and sums of c ln c and of c ln q, where q is the suffix's count or the root's probability."""
    symbol, number, place, c = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in table.column("rows").to_pylist()], axis=1)
    key = number.astype(np.uint64) << np.uint64(32) | symbol.astype(np.uint64)
    distinct, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, c).astype(np.int64)
    context, symbols = (distinct >> np.uint64(32)).astype(np.int64), distinct & np.uint64(0xFFFFFFFF)
    up = np.array([plan.number[s[:-1]] if len(s) > 1 else -1 for s in plan.open])[context]
    q = root.of_symbols(symbols)
    below = np.flatnonzero(up >= 0)
    q[below] = total[np.searchsorted(distinct, up[below].astype(np.uint64) << np.uint64(32) | symbols[below])]
    own, c = np.unique(context), np.maximum(total, 1)  # of symbols without training tokens here only the range hears
    figures = np.stack([np.bincount(context, w)[own] for w in (total, total > 0, total * np.log(c), total * np.log(np.maximum(q, 1e-300)))])
    pairs = np.unique(np.stack([place, at]), axis=1)
    starts = np.flatnonzero(np.r_[True, pairs[0, 1:] != pairs[0, :-1]])
    ranges = pairs[0, starts].tolist()
    data = [np.stack([context[x], symbols[x].astype(np.int64), total[x]]).tobytes() for x in np.split(pairs[1], starts[1:])]
    return pa.table({"range": pa.array([*ranges, -1], pa.int64()), "rows": _binary([*data, None]),
                     "figures": pa.array([*[None] * len(ranges), [[float(a), *b] for a, b in zip(own, figures.T.tolist(), strict=True)]], pa.list_(pa.list_(pa.float64())))})


def _chunks(made: DataFrame, plan: Plan) -> DataFrame:
    """The rows of each block, a record for each range."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch, *_BLOCK):
                columns, keys, doc = _of_block(row, plan.depth)
                ends = np.r_[0, cuts(keys, salt_of(row[0]), plan.bounds), len(doc)]
                there = np.flatnonzero(ends[:-1] < ends[1:])
                data = [packed(*[c[ends[k] : ends[k + 1]] for c in (*columns, doc)]) for k in there]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([row[0]] * len(there), pa.int64()), _binary(data)], ["range", "block", "data"])

    return made.select(*_BLOCK).mapInArrow(run, "range long, block long, data binary")


class Range:
    """The part of the tree that the rows of a range make: of each depth the rows' groups (contexts), and of the groups all that is known."""

    def __init__(self, chunks: pa.Table, answers: list[bytes], plan: Plan, figures: np.ndarray, root: Root, least: int, divergence: float, kept: np.ndarray):
        depth, least = plan.depth, max(least, 1)
        self.blocks = chunks.column("block").to_pylist()
        parts = [unpacked(x, depth + 2) for x in chunks.column("data").to_pylist()]
        self.block = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        rows = np.concatenate(parts, axis=1)
        del parts
        order = np.lexsort(sort_keys(list(rows[: depth + 1]))[::-1])
        columns, self.doc, self.block = list(rows[: depth + 1, order]), rows[depth + 1, order], self.block[order]
        symbol, trained = columns[-1].astype(np.int64), self.doc & 1 > 0
        self.p = root.of_symbols(symbol)
        del rows, order
        totals = np.concatenate([np.frombuffer(a, np.int64).reshape(3, -1) for a in answers], axis=1) if answers else np.empty((3, 0), np.int64)
        open_keys = totals[0] << 32 | totals[1]
        by_key = np.argsort(open_keys)
        open_keys, open_counts = open_keys[by_key], totals[2][by_key]
        change, q, self.levels = np.zeros(len(symbol), bool), self.p, []
        change[:1] = True
        for d, number in zip(range(depth), plan.numbers(columns), strict=False):
            change[1:] |= columns[d][1:] != columns[d][:-1]
            group = np.cumsum(change) - 1
            start = np.flatnonzero(change)
            n = np.bincount(group, trained)
            pair = group << 32 | symbol
            if d == depth - 1:
                new = np.r_[True, pair[1:] != pair[:-1]]
                at = np.cumsum(new) - 1
                pairs = pair[new]
            else:
                pairs, at = np.unique(pair, return_inverse=True)
            of_pair = np.bincount(at, trained)
            kinds = np.bincount(pairs >> 32, of_pair > 0)
            c = of_pair[at]
            opened = number[start]  # of the groups
            cut = np.flatnonzero(opened >= 0)
            n[cut], kinds[cut] = figures[opened[cut], 0], figures[opened[cut], 1]
            on = np.flatnonzero(number >= 0)
            if len(on):
                wanted = number[on] << 32 | symbol[on]
                where = np.minimum(np.searchsorted(open_keys, wanted), max(len(open_keys) - 1, 0))
                c[on] = np.where(open_keys[where] == wanted, open_counts[where], 0) if len(open_keys) else 0
            share = c / np.maximum(n, 1)[group]
            gain = np.bincount(group[trained], np.log(share[trained] / q[trained]), len(start)) / np.maximum(n, 1)
            gain[cut] = figures[opened[cut], 2]
            there = (n >= least) & (columns[d][start] > 0)
            self.levels.append({"group": group, "n": n, "kinds": kinds, "c": c, "there": there, "kept": there & (gain >= divergence), "open": opened})
            q = share
        for d in reversed(range(depth)):
            level = self.levels[d]
            if d + 1 < depth:
                longer = self.levels[d + 1]
                of = np.zeros(len(longer["n"]), np.int64)
                of[longer["group"]] = level["group"]
                level["kept"] |= np.bincount(of, longer["kept"], len(level["n"])) > 0
            cut = np.flatnonzero(level["open"] >= 0)
            level["kept"][cut] |= kept[level["open"][cut]]

    def kept_open(self) -> np.ndarray:
        """Numbers of the open contexts that this range retains, by their own divergence or by a longer one's."""
        return np.concatenate([level["open"][level["kept"] & (level["open"] >= 0)] for level in self.levels])

    def sums(self, discount: float) -> pa.Table:
        """The logarithms of the rows' probabilities, added up for each document: a record for each block."""
        p = self.p
        for level in self.levels:  # from the root to the longest retained suffix
            on = np.flatnonzero(level["kept"][level["group"]])
            g = level["group"][on]
            p[on] = (np.maximum(level["c"][on] - discount, 0) + discount * level["kinds"][g] * p[on]) / level["n"][g]
        keys, at = np.unique(self.block << 32 | self.doc >> 1, return_inverse=True)
        sums = np.bincount(at, np.log10(p))
        block = keys >> 32
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        docs, sums = (np.split(x, starts[1:]) for x in (keys & 0xFFFFFFFF, sums))
        return pa.table({"block": pa.array([self.blocks[b] for b in block[starts]], pa.int64()), "docs": _binary([packed(x) for x in docs]), "sums": _binary([x.tobytes() for x in sums])})


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, least: int = LEAST, divergence: float = DIVERGENCE, discount: float = DISCOUNT,
          block_tokens: int = BLOCK_TOKENS, depth: int = DEPTH, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    cut, cut_path = written_at(blocks(df, id_col, text_col, held, block_tokens), "lm-blocks")
    answer = "block long, part long, counts binary, numbers binary, tokens long, words long, values binary, sizes binary"
    parts = max(PARTS, 1 << (cut.count() // PART_BLOCKS).bit_length())
    answers, path = written_at(_word_requests(cut, parts).groupBy("part").applyInArrow(lambda t: _count_words(t, least), answer), "lm-words")
    root = Root(answers.where("tokens IS NOT NULL").select("part", "tokens", "words", "values", "sizes").collect(), least)  # a row for each part
    made = written(_numbered(cut, answers, root, depth), "lm-numbered")
    remove(spark, cut_path)
    remove(spark, path)
    plan = _plan(made, range_tokens, depth)
    figures, kept, asked = np.zeros((len(plan.open), 3)), np.zeros(len(plan.open), bool), None
    if plan.open:
        table = written(_open_requests(made, plan, parts).groupBy("part").applyInArrow(lambda t: _count_open(t, plan, root), "range long, rows binary, figures array<array<double>>"), "lm-open")
        asked = table.where("range >= 0").select("range", "rows")
        each = table.where("range < 0").select(F.explode("figures").alias("f")).groupBy(F.col("f")[0].cast("long").alias("k"))
        figures = _open_figures(plan, each.agg(*[F.sum(F.col("f")[i]) for i in range(1, 5)]).collect())  # a row for each open context
        kept = (figures[:, 0] >= max(least, 1)) & (figures[:, 2] >= divergence)
    grouped, shared = _chunks(made, plan), spark.sparkContext.broadcast((plan, figures, root))

    def ranged(out, schema: str, kept: np.ndarray) -> DataFrame:
        def run(chunks: pa.Table, rows: list[bytes]) -> pa.Table:
            plan, figures, root = shared.value
            return out(Range(chunks, rows, plan, figures, root, least, divergence, kept))

        if asked is None:
            return grouped.groupBy("range").applyInArrow(lambda chunks: run(chunks, []), schema)
        empty = pa.table({n: pa.array([], t) for n, t in zip(*_schema(schema), strict=True)})
        both = lambda chunks, rows: run(chunks, rows.column("rows").to_pylist()) if chunks.num_rows else empty
        return grouped.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(both, schema)

    if not kept.all():  # an open context without divergence of its own is a node if a longer one is
        found = ranged(lambda r: pa.table({"k": pa.array(r.kept_open(), pa.int64())}), "k long", kept).distinct().collect()
        kept = kept.copy()
        kept[[r.k for r in found]] = True
    sums = ranged(lambda r: r.sums(discount), "block long, docs binary, sums binary", kept)

    def total(block: pa.Table, parts: pa.Table) -> pa.Table:
        ((ids, held, lengths, known, base, own),) = _rows(block, "ids", "held", "lengths", "n_known", "base", "alone")
        own = np.array(own)
        for docs, x in sorted(_rows(parts, "docs", "sums")):
            own[unpacked(docs)[0]] += np.frombuffer(x)
        return pa.table({"id": pa.array(ids, block.schema.field("ids").type.value_type), "held_out": pa.array(held), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(known, pa.int64()),
                         "train_tokens": pa.array(np.full(len(ids), root.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(own)})

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    docs = made.select("block", "ids", "held", "lengths", "n_known", "base", "alone")
    return docs.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(total, schema).withColumnRenamed("id", id_col)


def _schema(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return tuple(zip(*[(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))], strict=True))


def _plan(made: DataFrame, range_tokens: int, depth: int) -> Plan:
    """Bounds from SAMPLED rows for each range, picked evenly from the blocks."""
    rows = made.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    ranges = max(1, -(-rows // range_tokens))
    share = SAMPLED * ranges / max(rows, 1)
    if ranges == 1:
        return Plan(np.empty((0, depth + 2), np.int64), 1, depth)
    taken = F.ceil(F.col("rows") * share) * (4 * (depth + 1))
    found = made.select("block", F.expr("picked").substr(F.lit(1), taken.cast("int")).alias("picked")).collect()  # SAMPLED rows for each range
    sample = []
    for r in found:
        x = np.frombuffer(r.picked, "<u4").reshape(-1, depth + 1).astype(np.int64)
        sample.append(np.c_[x, np.full(len(x), salt_of(r.block))])
    return Plan(np.concatenate(sample), ranges, depth)


def _open_figures(plan: Plan, rows: list) -> np.ndarray:
    """Occurrences, distinct symbols and divergence of each open context."""
    out = np.zeros((len(plan.open), 4))
    for k, *x in rows:
        out[k] = x
    n = np.maximum(out[:, 0], 1)
    up = np.array([np.log(n[plan.number[s[:-1]]]) if len(s) > 1 else 0.0 for s in plan.open])
    return np.c_[out[:, :2], out[:, 2] / n - np.log(n) - out[:, 3] / n + up]
