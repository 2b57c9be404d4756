"""Token ids as files of fixed-width bit packing, written in id order, with block offsets for random access.

A file: a header of 8 little-endian unsigned 64-bit integers (magic, bits per id, ids per block, documents, ids, and the byte offsets of
the ids' ends, the block offsets and the blocks), the documents' ids (signed 64-bit), where each document ends in the file (unsigned 64-bit),
the byte offset of each block (unsigned 64-bit), then the blocks. A block holds BLOCK ids (the last one fewer), each in the fewest bits that
the vocabulary needs, lowest bit first, padded to a whole byte; it unpacks by itself with numpy.

Defined results: a null text is an empty document, which holds only the end id; a null document id is written as the smallest integer, comes
first and is read back as null; repeated ids stay, next to each other. An empty table writes no file.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._shared import new_path, put_file

MAGIC = 0x314B504B4F54
#: Ids in a block, and in a file before the next one begins (a document is never split, so a longer one has a file of its own).
BLOCK, FILE_IDS = 4096, 2_000_000
#: Bytes of text that go into one task, and so about into one or two files.
TASK_BYTES = 16_000_000
NO_ID = -(2**63)


def bits_needed(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, lowest bit first. Widths of 16 and 32 bits need no shuffling of bits: the layout is that of the integers."""
    if bits in (16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8), axis=None, bitorder="little").tobytes()


def unpacked(data, bits: int, n: int) -> np.ndarray:
    if bits in (16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes @ (np.uint32(1) << np.arange(bits, dtype=np.uint32)) if n else np.empty(0, np.uint32)


def file_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    blocks = [packed(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    ends_at = 64 + 8 * len(doc_ids)
    offsets_at = ends_at + 8 * len(doc_ids)
    blocks_at = offsets_at + 8 * len(blocks)
    offsets = blocks_at + np.cumsum([0, *map(len, blocks[:-1])]) if blocks else np.empty(0)
    head = np.array([MAGIC, bits, BLOCK, len(doc_ids), len(ids), ends_at, offsets_at, blocks_at], "<u8")
    return b"".join([head.tobytes(), doc_ids.astype("<i8").tobytes(), np.cumsum(lengths).astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """A file's bytes (or a memory map of them); documents are unpacked one by one, from the blocks they lie in."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.block, n, self.n_ids, ends_at, offsets_at, _ = np.frombuffer(self.data[:64], "<u8").tolist()
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(self.data, "<i8", n, 64)
        self.ends = np.frombuffer(self.data, "<u8", n, ends_at).astype(np.int64)
        self.offsets = np.frombuffer(self.data, "<u8", -(-self.n_ids // self.block), offsets_at).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, counted over the file."""
        found = []
        for k in range(start // self.block, -(-stop // self.block)) if stop > start else ():
            n = min(self.block, self.n_ids - k * self.block)
            at = int(self.offsets[k])
            found.append(unpacked(self.data[at : at + (n * self.bits + 7) // 8], self.bits, n))
        first = start // self.block * self.block
        return np.concatenate(found)[start - first : stop - first] if found else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


class LibraryEncoder:
    """Ids by the tokenizers library, each distinct chunk between spaces or line feeds encoded once and remembered.

    Chunks that bpe.plain_pieces can split are encoded piece by piece, many pieces to a call: a piece's last token, and no other, bears the
    end-of-word suffix. Other chunks are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.suffix = suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.split = bpe.plain_pieces if suffix else lambda chunk: None
        # Plain pieces are normalised and split already: the same model without those steps gives the same ids.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        marks = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(marks)).search if marks else lambda chunk: None
        self.memo: dict[str, bytes] = {}

    def learn(self, chunks) -> None:
        whole, split = [], {}
        for chunk in chunks:
            pieces = self.split(chunk)
            if pieces is None or self.marked(chunk):
                whole.append(chunk)
            else:
                split[chunk] = pieces
        of = self.encoded(list({p for ps in split.values() for p in ps}))
        for chunk, ps in split.items():
            self.memo[chunk] = of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps])
        for chunk, e in zip(whole, self.tokenizer.encode_batch(whole, add_special_tokens=False), strict=True):
            self.memo[chunk] = np.array(e.ids, "<u4").tobytes()

    def learn_pieces(self, pieces) -> None:
        """The same for the pieces of plain texts, which need not be split again."""
        self.memo.update(self.encoded(list(pieces)))

    def encoded(self, pieces: list[str]) -> dict[str, bytes]:
        of = {}
        for i in range(0, len(pieces), 5000):
            some = pieces[i : i + 5000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cut) != len(some):
                raise ValueError("the tokenizer splits otherwise than plain_pieces does")
            raw = ids.tobytes()
            of.update(zip(some, [raw[4 * a : 4 * b] for a, b in zip([0, *cut], cut)], strict=True))
        return of


_LIBRARY: dict[str, LibraryEncoder] = {}


def library_encode(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text, as little-endian unsigned 32-bit integers."""
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryEncoder(path)
    known = _LIBRARY[path]
    return bpe.encode_by_unit(texts, known.memo, known.learn, known.marked, bpe.MEMO, known.learn_pieces if known.suffix else None)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write(df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Encodes every text, appends end_id, and writes files in ascending id order. Returns the folder and its index.

    The texts are range-partitioned by id (one shuffle; ids are sampled for the ranges, so a hot source or equal texts do not matter). The
    index has a row per file: part, file, name, n_docs, n_ids, start (ids in all files before it), and is stored beside the files.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "token-files")
    bits = bits_needed(vocabulary_size(tokenizer))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    ordered = rows.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id())

    def run(batches):
        part, file, held, n_held = 0, 0, [], 0

        def flush():
            name = f"{part:08d}-{file:06d}.tok"
            docs, ids = np.array([i for i, _ in held], np.int64), [x for _, x in held]
            put_file(folder, name, file_bytes(docs, np.array([len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<u4"), bits))
            return pa.RecordBatch.from_pylist([{"part": part, "file": file, "name": name, "n_docs": len(held), "n_ids": n_held}], schema)

        for slice_, texts in bpe.text_batches(batches, 1):
            part = slice_.column(2)[0].as_py()
            for i, ids in zip(slice_.column(0).to_pylist(), library_encode(tokenizer, texts), strict=True):
                ids += end_id.to_bytes(4, "little")
                if held and n_held + len(ids) // 4 > FILE_IDS:
                    yield flush()
                    file, held, n_held = file + 1, [], 0
                held.append((i, ids))
                n_held += len(ids) // 4
        if held:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    ordered.mapInArrow(run, "part int, file int, name string, n_docs long, n_ids long").write.parquet(f"{folder}/written")
    files = spark.read.parquet(f"{folder}/written")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote files
    base = {r.part: r.n for r in totals.collect()}
    before, starts = 0, []
    for part in sorted(base):
        starts.append((part, before))
        before += base[part]
    bases = spark.createDataFrame(starts, "part int, base long")
    from pyspark.sql import Window

    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.join(bases, "part").select("part", "file", "name", "n_docs", "n_ids", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start")).write.parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document read from the files: its id, start (over all files) and ids."""
    return _read(spark, folder, [T.StructField("ids", T.ArrayType(T.LongType()))], lambda ids: [pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], id_col)


def digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document read from the files: its id, start, n_tokens and the crc32 of its ids."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    return _read(spark, folder, fields, lambda ids: [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], id_col)


def _read(spark, folder, fields, derive, id_col):
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), *fields])
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    index = spark.read.parquet(f"{folder}/index").select("name", "start")
    files = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(index, "name")

    def run(batches):
        for batch in batches:
            for data, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(data.as_buffer())
                for i in range(0, len(f.ends), 500):
                    some = range(i, min(i + 500, len(f.ends)))
                    ids = pa.array([None if x == NO_ID else x for x in f.doc_ids[i : i + 500].tolist()], pa.int64())
                    starts = pa.array([base + (int(f.ends[k - 1]) if k else 0) for k in some], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, starts, *derive([f.document(k) for k in some])], schema.names)

    return files.select("content", "start").mapInArrow(run, schema)
