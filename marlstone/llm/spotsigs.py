"""Document fingerprints of spot signatures.

A spot is a common word; its signature is the spot with the next ``CHAIN`` content words, ``DISTANCE``
content words apart.  Navigation, tables and lists have few common words, so the signatures are those of
running text.  The fingerprint of a text is the whole set of the 32-bit values of its signatures,
in order and written in hex; the likeness of two fingerprints is the Jaccard measure of the sets.

``similar`` joins fingerprints: sets are partitioned by length so that only partitions whose lengths
allow the threshold meet, a prefix of rare values finds candidates, and the Jaccard measure is compared
with its length bound first.

Defined results: a null or empty text has an empty fingerprint; texts without a spot have one signature,
all their words; two empty fingerprints have likeness 1; the next document is by ascending id (null
first), equal ids by a hash of their text; the last document's next is the first; a table of one row is
its own next; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, mixed, partitions, small_batches

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
CHAIN, DISTANCE = 2, 1
TOGETHER = 4_000_000
FIRST = -(1 << 63)
# Common words of English, French, German and Spanish that serve as spots.
SPOTS = (
    "a an and are as at be been but by for from had has have he her his i in is it not of on or she that the their there they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour que qui sa se son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht noch nur sich sie sind so und von war wie wird zu zum zur "
    "al como con de del el en era es esta este fue ha la las lo los más no para pero por que se si sin su sus un una y"
)
MARKS = b".,;:!?\"'()[]{}<>*#%&$|/\\-_=+~`@^"
ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)]
_SPOTS = {w.encode() for w in SPOTS.split()}


def signature_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct 32-bit signature values of each text, sorted."""
    number: dict[bytes, int] = {}
    new = number.setdefault
    rows = [np.array([new(w, len(number)) for w in t.lower().split()], np.int64) for t in texts]
    cores = [w.strip(MARKS) for w in number]
    key_of = np.array([xxhash.xxh3_64_intdigest(c) for c in cores], np.uint64)
    kind_of = np.array([0 if not c else 2 if c in _SPOTS else 1 for c in cores], np.int8)
    out = []
    reach = (CHAIN - 1) * DISTANCE
    for row in rows:
        if not len(row):
            out.append(np.zeros(0, np.uint32))
            continue
        kind, keys = kind_of[row], key_of[row]
        content = np.nonzero(kind == 1)[0]
        spots = np.nonzero(kind == 2)[0]
        first = np.searchsorted(content, spots)
        whole = first + reach < len(content)
        spots, first = spots[whole], first[whole]
        if not len(spots):
            h = xxhash.xxh64()
            h.update(keys.tobytes())
            out.append(np.array([h.intdigest() & 0xFFFFFFFF], np.uint32))
            continue
        h = keys[spots]
        for k in range(CHAIN):
            h = mixed(h * ODD[k] + keys[content[first + k * DISTANCE]])
        out.append(np.unique((h >> U64(32)).astype(np.uint32)))
    return out


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard measure of two fingerprints."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` range-partitioned by id, each part with the first rows of the next part at its end.

    The splitters and the first id of each part are as many as there are parts.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    keyed = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("k"), "text")
    shares = [i / parts for i in range(1, parts)]
    splitters = sorted(set(keyed.agg(F.percentile_approx("k", shares, 100 * parts).alias("s")).first().s or [])) if shares else []

    def part_of(k: int) -> int:
        return bisect_right(splitters, k)

    @F.pandas_udf(T.IntegerType())
    def part(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(splitters, np.int64), k.to_numpy(), "right").astype(np.int32))

    firsts = {r.p: r.k for r in keyed.select("k").groupBy(part("k").alias("p")).agg(F.min("k").alias("k")).collect()}
    order = sorted(firsts)
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def targets(k: pd.Series) -> pd.Series:
        """The row's part; for a part's first id also the part before, as -1 less it."""
        return pd.Series([[part_of(x)] if x not in before else [part_of(x), -1 - before[x]] for x in k.tolist()])

    sent = keyed.withColumn("target", F.explode(targets("k")))
    sent = sent.select("k", "text", F.greatest("target", -1 - F.col("target")).alias("part"), (F.col("target") < 0).alias("extra"))
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("extra", "k", F.xxhash64("text"), "text"), parts


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and the next."""
    ordered, _ = in_order(docs)

    def make(batches):
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]):
            """All rows but the last, which only is the next of the one before."""
            texts = [(t or "") for _, t in rows]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            raw = [t.encode() for t in texts]
            raw_changed = [t.encode() for t in changed]
            sets = signature_sets(raw + raw_changed)
            own, other = sets[: len(raw)], sets[len(raw) :]
            columns = [
                pa.array([None if k == FIRST else k for k, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw_changed], pa.string()),
                pa.array([as_text(s) for s in own[:-1]], pa.string()),
                pa.array([as_text(s) for s in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ended = False
        for batch in batches:
            for k, text, extra in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), batch.column("extra").to_pylist()):
                if ended:
                    continue
                held.append((k, text))
                size += len(text or "")
                ended = extra
                if size >= TOGETHER and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(held[-1][1] or "")
        if len(held) > 1:
            yield flush(held)

    return ordered.select("k", "text", "extra").mapInArrow(make, OUT)


def similar(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of ``doc_id`` whose fingerprints have at least the given likeness; equal fingerprints are
    one class and paired with their least id only."""
    values = F.transform(F.sequence(F.lit(0), (F.length("fingerprint") / 8 - 1).cast("int")), lambda i: F.substring("fingerprint", i * 8 + 1, F.lit(8)))
    sets = prints.where("length(fingerprint) > 0 and doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", values.alias("vs"), F.expr("length(fingerprint) div 8").alias("n"))
    sizes = sets.select("doc_id", "vs", "n", F.explode("vs").alias("v"))
    rare = sizes.groupBy("v").agg(F.count("*").alias("df"))
    ranked = sizes.join(rare, "v").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("ranked"))
    prefix = F.slice("ranked", 1, (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    step = float(np.log(1 / threshold))
    by_length = ranked.select("doc_id", "n", F.explode(prefix).alias("p"), F.floor(F.log(F.col("n").cast("double")) / step).alias("part"))
    left = by_length.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("p.v").alias("v"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = by_length.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("p.v").alias("v"), "part")
    pairs = left.join(right, ["v", "part"]).where("a < b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()
    full = sets.select("doc_id", "vs")
    joined = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("vs").alias("va")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("vs").alias("vb")), "b")
    like = F.size(F.array_intersect("va", "vb")) / F.size(F.array_union("va", "vb"))
    return joined.select("a", "b", like.alias("likeness")).where(F.col("likeness") >= threshold)
