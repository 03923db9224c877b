"""What the corpus operators share: tables, cut lineage, words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at once.
BLOCK_BYTES = 4_000_000

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there and Spark knows its size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of ``cut`` frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches have a few megabytes at most; workers and executors hold several at a time."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(name).rstrip("b")) <= BLOCK_BYTES:
        conf.set(name, f"{BLOCK_BYTES}b")
    return docs


def fresh(name: str, taken) -> str:
    """A column name like ``name`` that is not taken, whatever the case of its letters."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % F.lit(mod)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x ^= x >> U64(27)
    x *= MIX_B
    x ^= x >> U64(31)
    return x


def byte_rows(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def trim() -> None:
    """Give freed memory back to the system; idle workers keep theirs otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about ``limit`` bytes of text, and their texts."""
    for batch in batches:
        rows = byte_rows(batch.column(text))
        start, held = 0, 0
        for i, row in enumerate(rows):
            held += len(row or b"")
            if held >= limit:
                yield batch.slice(start, i + 1 - start), rows[start : i + 1]
                start, held = i + 1, 0
        if start < len(rows):
            yield batch.slice(start), rows[start:]
        del rows
        trim()


def block_ids() -> Iterator[int]:
    """Numbers for the blocks of this task, the same if the task runs again."""
    base = TaskContext.get().partitionId() << 24
    k = 0
    while True:
        yield base + k
        k += 1


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits on space, tab, line feed, vertical tab, form feed and return."""
    return text.lower().split() if text else []


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of ``ascii_words`` of a block, which of them each word is, and where each text's words begin (and the last one's end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    coded = lists.flatten().dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    edges = lists.offsets.to_numpy().astype(np.int64)
    words = byte_rows(coded.dictionary)
    if b"" in words:  # at white space at a text's begin and end
        real = which != words.index(b"")
        edges = np.concatenate([[0], np.cumsum(real)])[edges]
        which = which[real]
    return words, which, edges


def few_or_joined(ids: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has at most ``most`` rows and to be joined if not."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids
