"""Benchmark decontamination by spaced seeds.

Every benchmark position is hashed under fixed masks that look at some of the next words and ignore
the others, so a substituted word spoils only the seeds that look at it.  Document positions with the
same hash are hits: the hashes of both sides are joined.  A hit fixes an alignment of document and item;
the overlap around it is verified word by word: some window of ``WINDOW`` words (the whole item if it is
shorter) must agree in at least ``AGREE`` of its words.  The masks find all such windows of ``MASKED`` words
and more; a shorter item is parted in one more piece than it may have other words, so that one piece is in
the document as it is.

Neither side is held in one place.  Documents send only the neighbourhoods of hashes that a bitmap of the
benchmark's hashes lets through; its size has a fixed bound, and when it fills up more is sent and nothing
lost.  Items of one text are one item.  The join of hashes is of two tables of plain rows, so that Spark
parts a frequent hash; its hits are counted once for each neighbourhood, item and alignment.

Defined results: documents without such a window have no row; a null or empty text or item matches
nothing; an item of fewer than five words matches only as it is; texts of any length are looked at as a
whole; repeated rows of a document give one row, as do repeated items of an id; empty tables give no rows;
of equally good windows the first in document and item is reported; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, block_ids, blocks, coded_words, cut, drop, few_or_joined, fresh, mixed, small_batches

#: Offsets that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 4, 5, 7))
WINDOW, AGREE, MASKED = 16, 0.8, 12
#: Bits of the bitmap, as powers of two, its bits for a hash, and the places of a hash in it.
LEAST_BITS, MOST_BITS, ROOM, PROBES = 24, 26, 32, 3
FEW, STEP = 500_000, 19
SEED = "kind int, key long, item long, at int"
NEAR = "region long, doc_id long, text_key long, start long, words binary, kinds array<int>, keys array<long>, ats array<long>"
FOUND = "doc_id long, text_key long, item long, matched long, compared long, doc_start long, item_start long"
ODD = mixed(np.arange(1, 65, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def pieces(size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of an item of fewer than ``MASKED`` words."""
    other = next(k for k in range(size, -1, -1) if size - k >= AGREE * size)
    ends = [size * i // (other + 1) for i in range(other + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def offsets(kind: int) -> tuple[int, ...]:
    """What seeds of a kind look at: a mask, or as many words as the kind says after the masks."""
    return MASKS[kind] if kind < len(MASKS) else tuple(range(kind - len(MASKS) + 1))


def seeds(words: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of all positions at which a seed of the kind fits."""
    mask = offsets(kind)
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, U64(kind), np.uint64)
    for odd, at in zip(ODD, mask):
        h += words[at : at + n] * odd
    return mixed(h)


def item_seeds(size: int) -> list[tuple[int, range]]:
    """The kinds of seeds of an item of ``size`` words, and the places that they are taken from."""
    if size >= MASKED:
        return [(k, range(size - mask[-1])) for k, mask in enumerate(MASKS)]
    return [(len(MASKS) + n - 1, range(at, at + 1)) for at, n in pieces(size)] if size else []


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one row, and where each text's begin."""
    words, which, edges = coded_words(texts)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[which] if len(which) else np.zeros(0, np.uint64), edges


def distinct_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and texts of the items by a key of their text: (item_id, item) and (item, words), written."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item"), "text")

    def hashed(batches):
        for batch, _ in blocks(batches):
            words, edges = word_hashes(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([words[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["item", "words"])

    words = rows.select("item", "text").dropDuplicates(["item"]).mapInArrow(hashed, "item long, words binary")
    return cut(rows.select("item_id", "item").distinct()), cut(words)


def seeded(items: DataFrame) -> DataFrame:
    """The seeds of all items."""

    def make(batches):
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                words = np.frombuffer(raw, np.uint64)
                for kind, places in item_seeds(len(words)):
                    key = seeds(words, kind)[places.start : places.stop].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(np.full(len(key), item, np.int64)), pa.array(np.array(places, np.int32))], ["kind", "key", "item", "at"])

    return items.mapInArrow(make, SEED)


def bitmap(rows: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the hashes; of ``2 ** MOST_BITS`` bits at most, however many hashes there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, (ROOM * rows.count()).bit_length()))
    slots = F.explode(F.array(*[F.shiftrightunsigned(F.shiftleft("key", STEP * k), 64 - bits) for k in range(PROBES)]))
    words = rows.select(slots.alias("slot")).select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return bits, out.view(np.uint64)


def in_bitmap(h: np.ndarray, bits: int, held: np.ndarray) -> np.ndarray:
    """The places of the hashes that the filter lets through."""
    at = np.arange(len(h))
    for k in range(PROBES):
        slot = h[at] << U64(STEP * k) >> U64(64 - bits)
        at = at[(held[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) > 0]
    return at


def neighbourhoods(docs: DataFrame, kinds: list[int], filter_: tuple[int, np.ndarray]) -> DataFrame:
    """The parts of texts around hashes that may be the benchmark's, with those hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)  # of a fixed size at most

    def scan(batches):
        bits, held = shared.value
        ids = block_ids()
        for batch, _ in blocks(batches):
            words, edges = word_hashes(batch.column("text"))
            last = np.repeat(edges[1:], np.diff(edges))  # the end of each word's text
            places, kind_of, key_of = [], [], []
            for kind in kinds:
                h = seeds(words, kind)
                at = in_bitmap(h, bits, held)
                at = at[at + offsets(kind)[-1] < last[at]]
                places.append(at), kind_of.append(np.full(len(at), kind, np.int32)), key_of.append(h[at].view(np.int64))
            at = np.concatenate([np.zeros(0, np.int64), *places])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, kind, key = at[order], np.concatenate(kind_of)[order], np.concatenate(key_of)[order]
            text = np.searchsorted(edges, at, "right") - 1
            new = np.nonzero(np.diff(at, prepend=-(1 << 40)) > 2 * WINDOW)[0]
            new = np.union1d(new, np.nonzero(np.diff(text, prepend=-1))[0])
            docs_, keys_ = batch.column("doc_id"), batch.column("text_key")
            out: list[tuple] = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)]):
                t = int(text[a])
                first, end = max(int(edges[t]), int(at[a]) - WINDOW + 1), min(int(edges[t + 1]), int(at[b - 1]) + WINDOW)
                out.append((next(ids), docs_[t].as_py(), keys_[t].as_py(), first - int(edges[t]), words[first:end].tobytes(), kind[a:b], key[a:b], at[a:b] - first))
            types = (*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], [c.split()[0] for c in NEAR.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(scan, NEAR)


def best_window(words: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """Of an alignment (place in ``words`` less place in ``item``): matched words, window length, place in words and item."""
    size = min(WINDOW, len(item))
    lo, hi = max(0, -diagonal), min(len(item), len(words) - diagonal)
    if not size or hi - lo < size:
        return None
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == words[lo + diagonal : hi + diagonal])])
    in_window = same[size:] - same[:-size]
    best = int(in_window.argmax())
    if in_window[best] < AGREE * size:
        return None
    return int(in_window[best]), size, lo + best + diagonal, lo + best


def verified(candidates: DataFrame) -> DataFrame:
    """The candidate alignments with a window that agrees."""

    def check(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                got = best_window(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64), r["diagonal"])
                if got:
                    out.append((r["doc_id"], r["text_key"], r["item"], got[0], got[1], r["start"] + got[2], got[3]))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    return candidates.mapInArrow(check, FOUND)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Alignments of texts and distinct items, and the ids of the items; nothing if no item has words."""
    names, items = distinct_items(small_batches(benchmark))
    rows = cut(seeded(items))
    kinds = sorted(r.kind for r in rows.select("kind").distinct().collect())  # a few masks and lengths
    if not kinds:
        drop(names, items, rows)
        return None
    near = cut(neighbourhoods(docs, kinds, bitmap(rows)))
    hits = near.select("region", F.explode(F.arrays_zip("kinds", "keys", "ats")).alias("h")).select("region", F.col("h.kinds").alias("kind"), F.col("h.keys").alias("key"), F.col("h.ats").alias("place"))
    aligned = cut(hits.join(rows, ["kind", "key"]).select("region", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct())
    texts = near.select("region", "doc_id", "text_key", "start", "words")
    found = cut(verified(aligned.join(texts, "region").join(items.select("item", F.col("words").alias("item_words")), "item").select("doc_id", "text_key", "start", "words", "item", "item_words", "diagonal")))
    drop(items, rows, near, aligned)
    return found, names


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that overlap."""
    got = overlaps(docs, benchmark)
    if got is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, compared long, doc_start long, item_start long")
    found, names = got
    first = F.struct((-F.col("matched")).alias("rank"), "doc_start", "item_start", "matched", "compared")
    best = found.join(names, "item").groupBy("doc_id", "item_id").agg(F.min(first).alias("best"))
    return best.select("doc_id", "item_id", *[F.col(f"best.{c}").alias(c) for c in ("matched", "compared", "doc_start", "item_start")])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose own text overlaps no benchmark item, with their columns."""
    got = overlaps(docs, benchmark)
    if got is None:
        return docs
    found, names = got
    own = fresh("text_key", docs.columns)
    keys = cut(found.select(F.col("text_key").alias(own)).distinct())
    drop(found, names)
    return docs.join(few_or_joined(keys, FEW), F.xxhash64("text") == F.col(own), "left_anti")
