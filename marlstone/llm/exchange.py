"""Blocks of documents that ask buckets of hashes about the whole corpus.

A block is a few megabytes of documents of one input partition.  It sends its distinct hashes, sorted
and packed, to the buckets of a range partitioning of the hash space, one row per bucket; the buckets
answer in the same order.  So a frequent key costs one entry a block, whatever its count.  There are
several buckets to a task, in proportion to the input; a task sorts its rows by bucket and holds those of
one bucket at a time.  Blocks are numbered by input partition and place; a checksum makes sure that
answers meet the block that asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_ids, blocks, partitions, small_batches

PAYLOAD = "block long, checksum long, docs binary, lengths binary, flags binary, texts binary"
NO_DOC = np.iinfo(np.int64).min


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers, compressed byte plane by byte plane."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: low bytes as they are, as many as the mean gap has, and the differences of what is above."""
    if not len(keys):
        return b""
    low = min(7, max(0, (int(keys[-1] - keys[0]) // len(keys)).bit_length() - 1) // 8)
    tail = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
    head = keys >> np.uint64(8 * low)
    gaps = pack_numbers(np.diff(head))
    return bytes([low]) + int(head[0]).to_bytes(8, "little") + len(gaps).to_bytes(8, "little") + gaps + tail


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    low, size = data[0], int.from_bytes(data[9:17], "little")
    head = np.concatenate([np.frombuffer(data[1:9], "<u8"), unpack_numbers(data[17 : 17 + size]).astype(np.uint64)])
    keys = np.cumsum(head, dtype=np.uint64) << np.uint64(8 * low)
    if low:
        wide = np.zeros((len(keys), 8), np.uint8)
        wide[:, :low] = np.frombuffer(data, np.uint8, offset=17 + size).reshape(-1, low)
        keys |= wide.reshape(-1).view(np.uint64)
    return keys


def bucket_slices(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Edges of the buckets in sorted keys of the given bits."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def checksum(texts: list[bytes | None]) -> int:
    h = xxhash.xxh64()
    for t in texts:
        h.update(b"%d:" % len(t or b""))
        h.update(t or b"")
    return h.intdigest() >> 1


def numbered(batches: Iterator[pa.RecordBatch], limit: int):
    """Blocks with their numbers, document ids and flags; input columns doc_id, text, flag."""
    ids = block_ids()
    for batch, texts in blocks(batches, limit=limit):
        docs = np.array([NO_DOC if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64)
        flags = np.array(batch.column("flag").to_pylist(), np.uint8)
        yield next(ids), docs, flags, [t or b"" for t in texts]


def asked(docs: DataFrame, flag=None) -> DataFrame:
    """The columns that ``numbered`` takes: an id, a text and a flag."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(flag if flag is not None else F.lit(0), F.lit(0)).cast("int").alias("flag"))


def payload(source: DataFrame, limit: int) -> DataFrame:
    """A row per block with its compressed texts."""

    def pack(batches):
        for block, docs, flags, texts in numbered(batches, limit):
            squeezed = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            row = [block, checksum(texts), docs.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), flags.tobytes(), squeezed]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["block", "checksum", "docs", "lengths", "flags", "texts"])

    return source.mapInArrow(pack, PAYLOAD)


def unpack_payload(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Document ids, flags and texts of a payload row."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    whole = zstandard.ZstdDecompressor().decompress(row["texts"]) if lengths.sum() else b""
    ends = np.cumsum(lengths)
    return np.frombuffer(row["docs"], np.int64), np.frombuffer(row["flags"], np.uint8), [whole[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]


def many_buckets(source: DataFrame) -> int:
    """Buckets for the hashes of ``source``: in proportion to its input, so that a bucket's share does not grow with it."""
    return 4 * max(partitions(source.sparkSession), source.rdd.getNumPartitions())


def answered(requests: DataFrame, answer, schema: str) -> DataFrame:
    """Deal request rows by bucket; ``answer`` gets the rows of one bucket and kind after the other, in the order of blocks."""

    def treat(batches):
        own, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bucket"], row["kind"]) != own and held:
                    yield from answer(held)
                    held = []
                own = row["bucket"], row["kind"]
                held.append(row)
        if held:
            yield from answer(held)

    parts = partitions(requests.sparkSession)
    dealt = requests.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("bucket", "kind", "block").mapInArrow(treat, schema)
