"""Token ids as binary blocks with Elias-Fano document boundaries.

A block holds the ids of consecutive documents in ascending id order, one after the other, with 2 or 4 bytes an id. Two
Elias-Fano sequences index it: where each document ends, and the document ids. Both take about 2 + log2(universe / n)
bits a document, and a small sample of positions lets ``select`` find one entry without unpacking the rest. A block is
one row of a Parquet file, so Spark's commit protocol covers lost tasks and any store that Spark writes to will do.

Null and empty texts are documents that hold the end id alone. Rows with null ids come last. Repeated ids stay apart, in
an order fixed by their texts. An empty table gives no block.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from revlens.llm import pretokens
from revlens.llm.common import col, documents, held, shuffle_partitions, text_slices, tokenizer_file
from revlens.llm.ordered import in_order
from revlens.session import scratch_path

BLOCK_IDS = 500_000
SAMPLE = 256  # ones between two sampled positions of the upper bits
HEAD = struct.Struct("<4sQQB")


class EliasFano:
    """A non-decreasing sequence of n integers below ``universe``."""

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(),
                   ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return b"".join([HEAD.pack(b"EFS1", self.n, self.universe, self.low_bits), self.samples.tobytes(), self.low, self.high])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, n, universe, low_bits = HEAD.unpack_from(data)
        if magic != b"EFS1":
            raise ValueError("not an Elias-Fano sequence")
        at = HEAD.size
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        at += samples.nbytes
        low = data[at: at + -(-n * low_bits // 8)]
        return cls(n, universe, low_bits, low, data[at + len(low):], samples)

    def select(self, i: int) -> int:
        """Entry i, from the sample before it and the upper bits after that."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(place, 8)
        word = self.high[byte] >> bit << bit
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        upper = byte * 8 + (word & -word).bit_length() - 1 - i
        start, lower = i * self.low_bits, 0
        if self.low_bits:
            first, shift = divmod(start, 8)
            chunk = int.from_bytes(self.low[first: (start + self.low_bits + 7) // 8], "little")
            lower = chunk >> shift & (1 << self.low_bits) - 1
        return upper << self.low_bits | lower

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        upper = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return upper
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        return upper | bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


class TokenBlock:
    """Random access to one block."""

    def __init__(self, row):
        self.ends, self.doc_ids = EliasFano.from_bytes(bytes(row["ends"])), EliasFano.from_bytes(bytes(row["doc_ids"]))
        self.first_id, self.n_docs = row["first_id"], row["n_docs"]
        self.ids = np.frombuffer(bytes(row["ids"]), f"<u{row['id_bytes']}")

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return self.first_id + self.doc_ids.select(i) if i < self.doc_ids.n else None

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.offsets(i)
        return self.ids[start:end]


class LibraryEncoder(pretokens.ChunkEncoder):
    """Ids by the tokenizers library's model, called once per distinct word (see ``pretokens`` for why that is enough)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.id_bytes = 2 if library.get_vocab_size() <= 1 << 16 else 4
        kind, model = "H" if self.id_bytes == 2 else "I", library.model
        super().__init__(library, lambda order: (array(kind, [t.id for t in model.tokenize(w)]).tobytes() for w in order),
                         self.id_bytes, remembered=300_000)


BLOCK_SCHEMA = ("shard int, block int, shard_start bigint, n_docs bigint, n_ids bigint, id_bytes int, first_id bigint, "
                "doc_ids binary, ends binary, ids binary")


def write_token_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
                       block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append ``end_id``, and write blocks in ascending order of ``key`` to ``path``."""
    spark = docs.sparkSession
    rows, shard, _ = in_order(docs.select(col(key).cast("bigint").alias("k"), col(text).alias("t")), "k", "t",
                              shuffle_partitions(spark))

    def task(batches):
        encoder = held("library", tokenizer, lambda: LibraryEncoder(tokenizer))
        width = encoder.id_bytes
        end = end_id.to_bytes(width, "little")
        number, block, start, keys, codes, held_ids = None, 0, 0, [], [], 0

        def flush():
            known = [k for k in keys if k is not None]
            first = known[0] if known else 0
            ends = np.cumsum([len(c) // width for c in codes])
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([number], pa.int32()), "block": pa.array([block], pa.int32()), "shard_start": [start],
                "n_docs": [len(codes)], "n_ids": [int(ends[-1])], "id_bytes": pa.array([width], pa.int32()),
                "first_id": [first],
                "doc_ids": pa.array([EliasFano.build(np.array(known, np.int64) - first).to_bytes()], pa.binary()),
                "ends": pa.array([EliasFano.build(ends).to_bytes()], pa.binary()), "ids": pa.array([b"".join(codes)], pa.binary()),
            })

        for batch in batches:
            for part in text_slices(batch, 1):
                for k, c, n in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()),
                                   part.column(2).to_pylist(), strict=True):
                    if codes and (held_ids >= block_ids or n != number):
                        yield flush()
                        block, start = (block + 1, start + held_ids) if n == number else (0, 0)
                        keys, codes, held_ids = [], [], 0
                    number = n
                    keys.append(k)
                    codes.append(c + end)
                    held_ids += len(codes[-1]) // width
        if codes:
            yield flush()

    rows.select("k", "t", col(shard)).mapInArrow(task, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_blocks(spark, path: str) -> DataFrame:
    """Blocks with ``start``, the number of ids before each."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    # a row per shard, of which there are as many as write partitions
    return blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def index_documents(blocks: DataFrame, checksums: bool = True) -> DataFrame:
    """One row per document of the blocks: doc_id, start, n_tokens, crc32 of its ids as 4-byte integers."""
    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano.from_bytes(row["ends"]).all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                keys = EliasFano.from_bytes(row["doc_ids"]).all() + row["first_id"]
                ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)] if checksums else [None] * len(ends)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([*keys.tolist(), *[None] * (len(ends) - len(keys))], pa.int64()),
                    "start": pa.array(starts + row["start"], pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    return blocks.select("start", "id_bytes", "first_id", "doc_ids", "ends", "ids").mapInArrow(
        task, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_blocks(spark, folder):
    path = scratch_path(spark, "token-blocks")
    write_token_blocks(documents(spark, folder), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return index_documents(read_token_blocks(spark, path))
