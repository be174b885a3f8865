"""Token ids in bit-plane shuffled blocks: transposed, compressed by plane, indexed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dialogue_factors.llm.common import batch, chunks, utf8
from dialogue_factors.llm.tokens import CHUNK_BYTES, WordEncoder, default_tokenizer
from dialogue_factors.session import scratch_path

BLOCK_IDS = 1 << 16
# A row of the file: one block. planes: the compressed planes end to end, plane_ends: where
# each ends. The index columns name the documents of the block: number of the document in
# its shard, how many of its ids the block has, and how many follow in later blocks.
BLOCKS = (
    "shard long, block long, first_id long, n_ids long, width int, planes binary, plane_ends array<long>, "
    "docs array<long>, doc_ids array<long>, doc_sizes array<long>, doc_rest array<long>"
)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block: byte k of every id, or bit k of every id."""
    matrix = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        matrix = np.unpackbits(matrix, axis=1, bitorder="little")
        return [np.packbits(matrix[:, k]).tobytes() for k in range(32)]
    return [matrix[:, k].tobytes() for k in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        matrix = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        matrix = np.packbits(matrix, axis=1, bitorder="little")
    else:
        matrix = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(matrix).reshape(-1).view("<u4")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32 (bits reflected)."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def crc_followed_by(crc: int, n_bytes: int) -> int:
    """What a part's CRC-32 adds (by xor) to that of the whole, `n_bytes` before its end."""
    power, base = 0x80000000, 0x00800000  # 1 and x**8
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, base)
        base, n_bytes = _times(base, base), n_bytes >> 1
    return _times(crc, power)


def write_blocks(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1,
    block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3,
) -> None:
    """Encode whole texts and write their ids in ascending `doc_id` order.

    Documents are dealt by ranges of `doc_id` (null first; equal ids by text, and equal
    rows spread by a salt), so each task writes one shard of consecutive documents. A
    shard is cut into blocks of `block_ids` ids; a block is transposed into byte planes
    (bit planes with `bits`), each compressed with zstandard. Spark's own Parquet
    writer commits the rows, so a lost or repeated task leaves no half-written shard.
    Null texts are empty and have the end id only. Other columns are not read.
    """
    encoder_path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, packer = WordEncoder(encoder_path), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=level)
        held, index, filled, number, block, first = [], [], 0, 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            packed = [packer.compress(p) for p in to_planes(ids, bits)]
            columns = list(zip(*index))
            kinds = pa.list_(pa.int64())
            return batch(
                shard=pa.array([shard], pa.int64()), block=pa.array([block], pa.int64()), first_id=pa.array([first], pa.int64()),
                n_ids=pa.array([len(ids)], pa.int64()), width=pa.array([len(packed)], pa.int32()),
                planes=pa.array([b"".join(packed)], pa.binary()), plane_ends=pa.array([np.cumsum([len(p) for p in packed]).tolist()], kinds),
                **{n: pa.array([list(c)], kinds) for n, c in zip(("docs", "doc_ids", "doc_sizes", "doc_rest"), columns)},
            )

        for rows in batches:
            _, sizes = utf8(rows.column(1))
            for low, high in chunks(sizes, CHUNK_BYTES):
                part = rows.slice(low, high - low)
                flat, offsets = encoder.encode(part.column(1))
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    ids = np.append(flat[offsets[i]:offsets[i + 1]], np.uint32(end_id))
                    at = 0
                    while at < len(ids):
                        take = min(len(ids) - at, block_ids - filled)
                        held.append(ids[at:at + take])
                        index.append((number, doc_id, take, len(ids) - at - take))
                        at, filled = at + take, filled + take
                        if filled == block_ids:
                            yield flush()
                            held, index, filled, block, first = [], [], 0, block + 1, first + block_ids
                    number += 1
        if held:
            yield flush()

    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text")).withColumn("salt", salt)
        .repartitionByRange("doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie", "salt")
    )
    ordered.select("doc_id", "text").mapInArrow(write, BLOCKS).write.option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Read a written file back: `doc_id, start, n_tokens, ids_crc32` of every document.

    Blocks are decoded wherever they lie. A document that spans blocks is put together
    from its parts by sum and xor, so its ids never meet in one place. `start` adds the
    sizes of earlier shards (a row for each) to the place in the shard.
    """
    blocks = spark.read.parquet(path)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for rows in batches:
            for row in rows.to_pylist():
                ends = [0, *row["plane_ends"]]
                limit = max(row["n_ids"], 1)
                ids = from_planes([unpacker.decompress(row["planes"][a:b], limit) for a, b in zip(ends, ends[1:])], row["n_ids"])
                cuts = np.cumsum([0, *row["doc_sizes"]])
                crcs = [
                    crc_followed_by(zlib.crc32(ids[a:b].tobytes()), 4 * rest) if rest else zlib.crc32(ids[a:b].tobytes())
                    for a, b, rest in zip(cuts, cuts[1:], row["doc_rest"])
                ]
                n = len(crcs)
                yield batch(
                    shard=pa.array([row["shard"]] * n, pa.int64()), number=pa.array(row["docs"], pa.int64()),
                    doc_id=pa.array(row["doc_ids"], pa.int64()), at=pa.array((row["first_id"] + cuts[:-1]).tolist(), pa.int64()),
                    size=pa.array(row["doc_sizes"], pa.int64()), crc=pa.array(crcs, pa.int64()),
                )

    read = blocks.mapInArrow(parts, "shard long, number long, doc_id long, at long, size long, crc long")
    whole = read.groupBy("shard", "number").agg(
        F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("size").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    return whole.join(shards, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write the ids of `docs` and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    write_blocks(docs, path, **options)
    return read_documents(spark, path)
