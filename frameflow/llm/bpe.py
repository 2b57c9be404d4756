"""BPE encoding and decoding with a pair occurrence index.

A batch of distinct pieces is laid out as one array of symbols. An index maps each mergeable pair to every position where it occurs; the
active ranks are applied in ascending order, each to all its positions at once, and only the lists of pairs that a merge touches change.
The work for a distinct piece is done once; texts are then put together from their pieces.

Defined results: a null text is encoded as the empty text (no ids); special-token strings in a text become their ids, as the tokenizer file
says; repeated rows are encoded each. No text is cut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text that are split at once in a worker, and entries of its memo of chunks; both bound memory, neither changes results.
BATCH_CHARS, MEMO = 2_000_000, 400_000

# The tokenizer's own split, for chunks of ASCII and Latin-1 letters (none of which composes with another, and of which each has one
# lower case); every other chunk is normalised and split by the library's components.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
_PLAIN_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\x0b\x0c\r a-zß-öø-ÿ0-9]+").findall


def plain_pieces(chunk: str) -> list[str] | None:
    """The lower-cased pieces of a chunk of ASCII and Latin-1 letters; None for any other."""
    if not _PLAIN(chunk):
        return None
    low = chunk.lower()
    return [low] if low.isalpha() else _PLAIN_PIECES(low)


class PairIndexBpe:
    """Encoder and decoder for a tokenizer file whose model is BPE over byte symbols with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or spec.get("decoder") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("this tokenizer file is of a kind that is not supported")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank_of_made = {t: r for r, t in enumerate(self.made.tolist())}
        for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if rank_of_made.get(a, -1) >= r or rank_of_made.get(b, -1) >= r:
                raise ValueError("a merge uses a symbol that a later merge makes: ranks can't be applied in ascending order")
        if len(rank_of_made) < len(merges):
            raise ValueError("two merges make the same symbol: ranks can't be applied in ascending order")
        keys = left << 32 | right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.left, self.right = left, right
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marked = self._special.search if self._special else lambda text: None
        whole = Tokenizer.from_file(path)
        self._normalize, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        marks = [f"a{c}b{c}{c}1{c}'s{c}" for c in map(chr, range(33, 256)) if _PLAIN(c)]
        if any(plain_pieces(x) != [p.lower() for p in _spelled_back(self._split(self._normalize(x)))] for x in marks):
            raise ValueError("this tokenizer file normalises or splits text in a way that is not supported")
        byte_char = _byte_characters()
        self._byte = {c: b for b, c in enumerate(byte_char)}
        self.inner = np.array([vocab[c] for c in byte_char], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_char], np.int64)
        self.tokens = [""] * (max(max(vocab.values()), *self.special.values(), 0) + 1)
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.memo: dict[str, bytes] = {}

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair (left id << 32 | right id), -1 where no merge has it."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.order[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each nonempty piece, as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[np.r_[0, ends[:-1]]] = -1
        symbol = np.r_[symbol, -1]  # at n: no symbol
        first = self.ranks(symbol[:-1] << 32 | np.where(after < n, symbol[np.minimum(after, n)], 0xFFFFFFFF))
        index: dict[int, list[int]] = defaultdict(list)
        found = np.flatnonzero(first >= 0)
        by_rank = found[np.argsort(first[found], kind="stable")]
        active, starts = np.unique(first[by_rank], return_index=True)
        for rank, positions in zip(active.tolist(), np.split(by_rank, starts[1:]) if len(active) else (), strict=True):
            index[rank] = positions.tolist()
        heap = active.tolist()  # sorted, so already a heap
        while heap:
            rank = heapq.heappop(heap)
            at = np.array(index.pop(rank), np.int64)
            if len(at) > 1:
                at.sort()
                at = at[np.r_[True, at[1:] != at[:-1]]]  # a pair whose two sides were both made in one step was listed twice
            a, b = self.left[rank], self.right[rank]
            nxt = after[at]
            ok = (symbol[at] == a) & (symbol[nxt] == b) & (nxt < n)
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:  # of overlapping occurrences, every other one from the left
                chained = np.r_[False, nxt[:-1] == at[1:]]
                k = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, k))
                at, nxt = at[(k - run) % 2 == 0], nxt[(k - run) % 2 == 0]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            symbol[nxt] = -2
            beyond = after[nxt]
            after[at] = beyond
            inside = beyond < n
            before[beyond[inside]] = at[inside]
            ahead = before[at]
            starts_at = np.concatenate((at[inside], ahead[ahead >= 0]))
            if not len(starts_at):
                continue
            fresh = self.ranks(symbol[starts_at] << 32 | symbol[after[starts_at]])
            known = fresh >= 0
            for r, p in zip(fresh[known].tolist(), starts_at[known].tolist(), strict=True):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(p)
        left_over = symbol[:n] >= 0
        ids = symbol[:n][left_over].astype("<u4").tobytes()
        cut = np.cumsum(left_over)[ends - 1] * 4
        return [ids[i:j] for i, j in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]

    def _pieces(self, chunk: str) -> list[bytes]:
        pieces = plain_pieces(chunk)
        if pieces is not None:
            return [x.encode() for x in pieces]
        return [bytes(map(self._byte.__getitem__, piece)) for piece, _ in self._split(self._normalize(chunk))]

    def _spelled(self, chunk: str) -> list[bytes | int]:
        """Its pieces, and the ids of special tokens in it."""
        if not self.marked(chunk):
            return self._pieces(chunk)
        return [x for part in self._special.split(chunk) for x in ([self.special[part]] if part in self.special else self._pieces(part))]

    def learn(self, chunks: Iterable[str]) -> None:
        """Puts the ids of these chunks (text without spaces or line feeds) into the memo."""
        spelled = {chunk: self._spelled(chunk) for chunk in chunks}
        distinct = list({x for xs in spelled.values() for x in xs if type(x) is bytes})
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        for token in self.special.values():
            ids[token] = token.to_bytes(4, "little")
        for chunk, xs in spelled.items():
            self.memo[chunk] = ids[xs[0]] if len(xs) == 1 else b"".join([ids[x] for x in xs])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Its units are encoded apart: the tokenizer never joins across white space or pieces."""
        return encode_by_unit(texts, self.memo, self.learn, self.marked, MEMO)

    def decode(self, ids: bytes) -> str:
        """As the library's decode without a decoder: token strings joined by spaces, special ones included."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_by_unit(texts: list[str], memo: dict[str, bytes], learn, marked, most: int, learn_pieces=None) -> list[bytes]:
    """The ids of each text, put together from those of its units; learn(units) adds what the memo lacks, learn_pieces(units) what plain texts lack.

    The units of a text of ASCII and Latin-1 letters are its lower-cased pieces; of another, or one with special tokens, its chunks.
    """
    plain = [bool(_PLAIN(t)) and not marked(t) for t in texts]
    split = [_PLAIN_PIECES(t.lower()) if p else t.replace("\n", " ").split(" ") for t, p in zip(texts, plain, strict=True)]
    pieces = set().union(*[units for units, p in zip(split, plain, strict=True) if p])
    chunks = set().union(*[units for units, p in zip(split, plain, strict=True) if not p])
    lacking = pieces.difference(memo), chunks.difference(memo, pieces)
    if len(memo) + len(lacking[0]) + len(lacking[1]) > most:
        kept = {unit: memo[unit] for unit in (pieces | chunks).intersection(memo)}
        memo.clear()
        memo.update(kept)
    (learn_pieces or learn)(lacking[0])
    learn(lacking[1])
    return [b"".join(map(memo.__getitem__, units)) for units in split]


def _spelled_back(pieces) -> list[str]:
    """The text of pieces that are written in byte characters."""
    byte = {c: b for b, c in enumerate(_byte_characters())}
    return [bytes(map(byte.__getitem__, piece)).decode() for piece, _ in pieces]


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def text_batches(batches: Iterable[pa.RecordBatch], column: int, most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of at most so many bytes of text (one row at least), with the texts; null is empty."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        group = np.cumsum(sizes) // most
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:]):
            if j > i:
                part = batch.slice(i, j - i)
                yield part, [t or "" for t in part.column(column).to_pylist()]


_LOADED: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    """The tokenizer of a file, once per worker."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>): the token ids of each text. One pass, no shuffle."""
    kind = df.schema[id_col].dataType

    def run(batches):
        bpe = loaded(tokenizer)
        for part, texts in text_batches(batches, 1):
            ids = bpe.encode_many(texts)
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").view("<i4"))
            offsets = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], [id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids array<int>")


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the decoded text of each array of ids; null ids are no ids."""
    kind = df.schema[id_col].dataType

    def run(batches):
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = [" ".join(map(bpe.tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, text string")


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded again in one pass without a shuffle."""
    kind = df.schema[id_col].dataType

    def run(batches):
        bpe = loaded(tokenizer)
        for part, texts in text_batches(batches, 1):
            out = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()) for ids in bpe.encode_many(texts)]
            n, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
