"""Token ids as fixed-width bits.

An id takes the fewest bits that hold every id of the vocabulary. Documents are written in ascending order of their ids,
some thousands of tokens to a block; a block has a header with the offset of each of its documents, so that a reader
unpacks a block with a few numpy operations, or a single document without the rest.

Block layout, all integers little-endian: the bytes ``TKB1``, bits per id (1 byte), 3 zero bytes, number of documents
(4), position of its first id in its part (8), first id of each document counted from the block's start and their total
(4 each), then the ids from the lowest bit of the first byte on. Blocks are rows of a Parquet table in the shared
folder, ``part, block, docs, tokens, payload``, which Spark commits as a whole: a lost executor leaves nothing half written.

Edge cases: null and empty texts have the end id only. Repeated and null ids are documents of their own; null comes
first, equal ids in the order of a hash of their texts. An empty table gives an empty file set. A document is never split.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents
from tickloom.llm.tokens import Encoder, word_encoder
from tickloom.session import scratch_path

MAGIC = b"TKB1"
END_ID = 2
BLOCK_TOKENS = 1 << 18


def width(vocabulary: int) -> int:
    """Bits for ids from 0 to ``vocabulary - 1``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from position ``first`` on, without reading the others."""
    if count == 0:
        return np.empty(0, np.uint32)
    if bits == 16:
        return np.frombuffer(payload, "<u2", count, 2 * first).astype(np.uint32)
    begin = first * bits // 8
    end = -(-(first + count) * bits // 8)
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, end - begin, begin), bitorder="little")
    flags = flags[first * bits - 8 * begin :][: count * bits].reshape(count, bits)
    return flags.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def write_block(docs: list[np.ndarray], position: int, bits: int) -> bytes:
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u4")
    return MAGIC + struct.pack("<BxxxIQ", bits, len(docs), position) + starts.tobytes() + pack(np.concatenate(docs), bits)


class Block:
    """A block that has been read: its documents by number."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.bits, self.docs, self.position = struct.unpack_from("<BxxxIQ", raw, 4)
        self.starts = np.frombuffer(raw, "<u4", self.docs + 1, 20)
        self.payload = memoryview(raw)[20 + 4 * (self.docs + 1) :]

    def ids(self, doc: int) -> np.ndarray:
        first, end = int(self.starts[doc]), int(self.starts[doc + 1])
        return unpack(self.payload, self.bits, first, end - first)


def write(docs: DataFrame, encoder: Encoder, path: str) -> None:
    """Write the documents' ids to ``path`` in ascending order of ``doc_id``, each with the end id.

    Texts are dealt out by ranges of ``doc_id``, sorted within a range, and encoded and packed as they come: dealing looks at ids and
    hashes only, so a text is encoded once. Positions count from the start of a part: what is before a part follows from
    the parts' token counts.
    """
    spark = docs.sparkSession
    bits = width(encoder.library.get_vocab_size())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number spreads rows that are equal
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    order = F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("number")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = position = size = 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def made() -> pa.RecordBatch:
            values = [part], [number], [names], [size], [write_block(held, position, bits)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["part", "block", "docs", "tokens", "payload"])

        kinds = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary()
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.encode(text.as_py()), np.uint32(END_ID))
                if held and size + len(ids) > BLOCK_TOKENS:
                    yield made()
                    number, position, size, held, names = number + 1, position + size, 0, [], []
                held.append(ids)
                names.append(name)
                size += len(ids)
        if held:
            yield made()

    dealt.mapInArrow(blocks, "part int, block int, docs array<long>, tokens long, payload binary").write.parquet(path)


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Tokens before each part; a row for each part comes to the driver."""
    sizes = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()
    before, total = {}, 0
    for row in sorted(sizes):
        before[row["part"]], total = total, total + row["tokens"]
    return before


def read(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of the files at ``path``: ``doc_id, start, n_tokens, ids_crc32, ids``; ids as little-endian 32-bit integers, or null."""
    blocks = spark.read.parquet(path)
    before = part_starts(blocks)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, names, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "payload"))):
                block = Block(raw)
                every = [block.ids(k).astype("<u4").tobytes() for k in range(block.docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(before[part] + block.position + block.starts[:-1].astype(np.int64)),
                        pa.array(np.diff(block.starts.astype(np.int64))),
                        pa.array([zlib.crc32(e) for e in every], pa.int64()),
                        pa.array(every if keep_ids else [None] * len(every), pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.select("part", "docs", "payload").mapInArrow(unpacked, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def document_ids(spark: SparkSession, path: str, part: int, block: int, number: int) -> np.ndarray:
    """Random access: the ids of one document, from its block alone."""
    row = spark.read.parquet(path).where((F.col("part") == part) & (F.col("block") == block)).select("payload").first()
    return Block(bytes(row["payload"])).ids(number)


def op7_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write(documents(spark, sf_dir).select("doc_id", "text"), word_encoder(), path)
    return read(spark, path, keep_ids=False).drop("ids")
