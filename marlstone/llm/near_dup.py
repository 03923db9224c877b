"""Near-duplicates by bottom-k sketches of word shingles.

One hash function gives each shingle a value; a document keeps its ``SKETCH`` least values.  Documents
with the same set are one class.  Of the classes, inverted lists of the ``PROBES`` least values bring
candidates together, the sketch of a pair's union estimates its overlap, and the full sets of what
passes are compared exactly.  A pair at the threshold meets in no list with a probability of 0.15^8
and fails the estimate with less than ``MISS``.

What is wanted is the classes of linked documents, so not all pairs of a list are compared:

* every list compares its members to its least member of about the same size;
* links are joined to components; a list whose members are all in one component is done;
* other short lists compare all their pairs that still lie in two components;
* other long lists compare their members to a few pivots; the documents of those that then still lie in
  several components, if enough of their sketch is not theirs alone, meet in an exact prefix join: with shingles in order of rarity a pair at the
  threshold has a common shingle among the rarest of both, at places that leave room for the threshold.
  So a document with much text of its own meets nobody, however many documents share the rest.

A pair is compared only if its sizes and the first ``BRIEF`` values of its sketches allow the threshold;
this is part of the join, so that other pairs never become rows.

Texts move only for verification: the pairs to verify are written first, and the documents of no pair are
left out where they are read, by a broadcast of the ids if these are few and by a join if not.  Links that are
found later extend the components of the earlier ones; exact copies follow their class.

Defined results: a null or empty text has no shingles and is linked with nothing; texts of any length are
compared as a whole; rows with the same id are one document, and of rows with the same id and text
``first_of_each`` keeps one; a row without an id is linked with nothing and kept; an empty table gives no
rows; columns beside ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, coded_words, cut, drop, few_or_joined, fresh, mixed, small_batches, trim
from .components import components, extended

SKETCHES = "doc_id long, n_shingles long, s1 long, s2 long, sketch array<long>"
SKETCH, BRIEF, PROBES, SHORT, PIVOTS = 64, 32, 8, 48, 4
MISS = 1e-7
#: Document ids that are broadcast at most; more are joined.
FEW_IDS = 500_000
ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0x85EBCA77C2B2AE63)]


def shingles(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The distinct 63-bit shingle values of each text, in order."""
    distinct, which, edges = coded_words(pa.array(texts, pa.string()))
    if not len(which):
        return [np.zeros(0, np.int64)] * len(texts)
    keys = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[which]

    def hashed(part: np.ndarray, size: int) -> np.ndarray:
        h = np.full(max(0, len(part) - size + 1), size, np.uint64)
        for k in range(size):
            h = mixed(h * ODD[0] + part[k : k + len(h)])
        return (h >> U64(1)).astype(np.int64)

    whole = hashed(keys, words)
    bounds = zip(edges.tolist(), edges[1:].tolist())
    return [np.unique(whole[a : b - words + 1] if b - a >= words else hashed(keys[a:b], b - a)[: b - a]) for a, b in bounds]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Set size, set signature and sketch of each text."""

    def make(batches):
        for batch, texts in blocks(batches):
            sets = shingles(texts, words)
            with np.errstate(over="ignore"):
                s1 = [int(np.add.reduce(s.view(np.uint64)).view(np.int64)) if len(s) else 0 for s in sets]
                s2 = [int(np.bitwise_xor.reduce(mixed(s.view(np.uint64))).view(np.int64)) if len(s) else 0 for s in sets]
            kept = [s[:SKETCH] for s in sets]
            offsets = np.cumsum([0, *(len(s) for s in kept)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), values], ["doc_id", "n_shingles", "s1", "s2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, SKETCHES)


def least_overlap(percent: int, size: int = SKETCH) -> int:
    """Fewest common values among ``size`` of a union that a pair at the threshold has but for ``MISS``."""
    p, total = percent / 100, 0.0
    for k in range(size + 1):
        total += comb(size, k) * p**k * (1 - p) ** (size - k)
        if total > MISS:
            return k
    return size


def may_link(sa, sb, percent: int, size: int):
    """Whether the least ``size`` values of a union leave room for the threshold."""
    union = F.slice(F.array_sort(F.array_union(sa, sb)), 1, size)
    common = F.size(F.array_intersect(union, F.array_intersect(sa, sb)))
    whole = F.size(union) < size  # then both sketches are the full sets
    return F.when(whole, 100 * common >= percent * F.size(union)).otherwise(common >= least_overlap(percent, size))


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is in the written table ``ids``; few ids go to the rows, many are joined."""
    return rows.join(few_or_joined(ids, FEW_IDS), "doc_id", "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    """The documents of written pairs, written."""
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())


def promising(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union's sketch leaves room for the threshold."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(may_link(F.col("sa"), F.col("sb"), percent, SKETCH)).select("a", "b")


def squeezed(docs: DataFrame) -> DataFrame:
    """Compressed texts of (doc_id, text) rows."""

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([packer.compress(t or b"") for t in texts], pa.binary())], ["doc_id", "body"])

    return docs.select("doc_id", "text").mapInArrow(squeeze, "doc_id long, body binary")


def confirmed(pairs: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    joined = pairs.join(bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b").join(bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a")

    def compare(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = part.column("body_a").to_pylist() + part.column("body_b").to_pylist()
                own = {body: None for body in rows}
                for body, values in zip(own, shingles([unpack(x) for x in own], words)):
                    own[body] = values
                ok = []
                for x, y in zip(rows[: len(part)], rows[len(part) :]):
                    a, b = own[x], own[y]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(100 * both >= percent * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
                del rows, own
        trim()

    return joined.select("a", "b", "body_a", "body_b").mapInArrow(compare, "a long, b long")


def lists(items: DataFrame) -> DataFrame:
    """Items of keys that at least two documents have, with the list's length."""
    sizes = items.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return items.join(sizes, "key")


def compared(left: DataFrame, right: DataFrame, by: list[str], percent: int, also=None) -> DataFrame:
    """Pairs of items with common keys that may reach the threshold."""
    a = left.select(*[F.col(c).alias(f"{c}__") for c in by], F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("brief").alias("ba"), F.col("component").alias("ca"))
    b = right.select(*by, F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("brief").alias("bb"), F.col("component").alias("cb"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(f"{c}__") == F.col(c))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    apart = F.col("ca") != F.col("cb")
    room = may_link(F.col("ba"), F.col("bb"), percent, BRIEF)
    joined = a.join(b, same & apart & sizes & room & (also if also is not None else F.lit(True)))
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(items: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the least member of about its size."""
    step = float(np.log(100 / percent))
    out = None
    for shift in (0.0, 0.5):
        own = items.withColumn("kind", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(shift)))
        pivots = own.groupBy("key", "kind").agg(F.min(F.struct("doc_id", "n", "brief", "component")).alias("p")).select("key", "kind", "p.*")
        pairs = compared(pivots, own, ["key", "kind"], percent)
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def some_pivots(items: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with ``PIVOTS`` members that a hash picks."""
    drawn = F.xxhash64("doc_id", F.lit("pivot"))
    own = items.withColumn("draw", drawn).withColumn("turn", F.pmod(drawn, F.lit(PIVOTS)))
    pivots = own.groupBy("key", "turn").agg(F.min(F.struct("draw", "doc_id", "n", "brief", "component")).alias("p")).select("key", "p.*")
    return compared(pivots, items, ["key"], percent)


def with_component(items: DataFrame, found: DataFrame) -> DataFrame:
    known = found.select(F.col("node").alias("doc_id"), "component")
    return items.drop("component").join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def undecided(items: DataFrame) -> DataFrame:
    """Items of lists that lie in several components."""
    open_keys = items.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("key")
    return items.join(open_keys, "key", "left_semi")


def least_company(n: int, percent: int) -> int:
    """Fewest values of a set of ``n`` < ``SKETCH`` that a partner at the threshold has in its sketch too.

    A partner of ``m`` values hides at most ``m - SKETCH`` common ones.
    """
    sizes = range(-(-n * percent // 100), n * 100 // percent + 1)
    return max(1, min(-(-percent * (n + m) // (100 + percent)) - max(0, m - SKETCH) for m in sizes))


def in_company(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The documents with enough sketch values that others of them have too for a pair at the threshold."""
    rows = docs.join(reps, "doc_id").select("doc_id", "n", F.explode("sketch").alias("key"))
    common = rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    small = F.array(*[F.lit(least_company(n, percent)) for n in range(1, SKETCH)])
    needed = F.when(F.col("n") < SKETCH, F.get(small, F.col("n").cast("int") - 1)).otherwise(least_overlap(percent, SKETCH))
    return rows.join(common, "key").groupBy("doc_id", "n").agg(F.count("*").alias("k")).where(F.col("k") >= needed).select("doc_id")


def full_sets(bodies: DataFrame, words: int) -> DataFrame:
    """The shingle values of squeezed texts, a row each."""

    def unfold(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = shingles([unpack(x) for x in part.column("body").to_pylist()], words)
                sizes = [len(s) for s in sets]
                ids = np.repeat(np.array(part.column("doc_id").to_pylist(), np.int64), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes).astype(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["doc_id", "n", "key"])

    return bodies.select("doc_id", "body").mapInArrow(unfold, "doc_id long, n long, key long")


def rarest(rows: DataFrame, percent: int) -> DataFrame:
    """For each set the values of its prefix in order of rarity, with their places."""
    counts = rows.groupBy("key").agg(F.count("*").alias("df"))
    ordered = rows.join(counts, "key").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("values"))
    prefix = F.slice("values", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return ordered.select("doc_id", "n", F.posexplode(prefix).alias("place", "v")).select("doc_id", "n", "place", "v.key")


def prefix_pairs(items: DataFrame, percent: int) -> DataFrame:
    """Pairs in two components with a common prefix value that leaves room for the threshold."""
    a = items.select(F.col("key").alias("k"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("component").alias("ca"))
    b = items.select("key", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("cb"))
    room = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    enough = (100 + percent) * room >= percent * (F.col("na") + F.col("nb"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    joined = a.join(b, (F.col("k") == F.col("key")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes & enough)
    return joined.select("a", "b").distinct()


def linked(docs: DataFrame, words: int = 3, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Id and set size of all rows, and the component of each document with shingles (columns node, component)."""
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = cut(sketches(texts, words))
    by = ["n_shingles", "s1", "s2"]
    sizes = cut(made.select("doc_id", *by))
    sets = sizes.where("n_shingles > 0 and doc_id is not null")
    classes = cut(sets.groupBy(*by).agg(F.min("doc_id").alias("rep")))
    heads = cut(classes.select(F.col("rep").alias("doc_id")).distinct())
    reps = cut(only(made, heads).select("doc_id", F.col("n_shingles").alias("n"), "sketch"))
    drop(made, heads)
    probes = lists(reps.select("doc_id", F.explode(F.slice("sketch", 1, PROBES)).alias("key")))
    brief = reps.select("doc_id", "n", F.slice("sketch", 1, BRIEF).alias("brief"), F.col("doc_id").alias("component"))
    items = cut(probes.join(brief, "doc_id"))

    def verified(found: DataFrame) -> DataFrame:
        """Links among candidate pairs: by the sketch of the union, then by the full sets."""
        pairs = cut(found)
        own = ends(pairs)
        left = cut(promising(pairs, only(reps, own), percent))
        drop(pairs, own)
        own = ends(left)
        bodies = cut(squeezed(only(texts, own)))
        links = cut(confirmed(left, bodies, words, percent))
        drop(left, own, bodies)
        return links

    later = F.col("a") < F.col("b")
    links = verified(stars(items, percent))
    known = components(links)
    drop(links)
    old, items = items, cut(undecided(with_component(items, known)))
    drop(old)
    short, long = items.where(F.col("size") <= SHORT), items.where(F.col("size") > SHORT)
    links = verified(compared(short, short, ["key"], percent, later).unionByName(some_pivots(long, percent)))
    old, known = known, extended(known, links)
    drop(old, links)
    open_docs = cut(undecided(with_component(long, known)).select("doc_id").distinct())
    drop(items)
    if not open_docs.isEmpty():
        left = cut(in_company(open_docs, only(reps, open_docs), percent))
        bodies = cut(squeezed(only(texts, left)))
        rows = cut(undecided(with_component(lists(rarest(full_sets(bodies, words), percent)), known)))
        drop(left, bodies)
        links = verified(prefix_pairs(rows, percent))
        old, known = known, extended(known, links)
        drop(old, links, rows)
    drop(open_docs, reps)
    classed = cut(sets.join(classes, by).select("doc_id", "rep").distinct())
    drop(classes)
    several = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("doc_id", "a")
    links = cut(classed.join(several, "doc_id").select("a", F.col("rep").alias("b")))  # ids that have several texts
    if not links.isEmpty():
        old, known = known, extended(known, links)
        drop(old)
    drop(links)
    own = classed.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return sizes.select("doc_id", "n_shingles"), own.select(F.col("doc_id").alias("node"), F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """Set size and component of every row of ``docs``; the least document of a component is kept."""
    made, found = linked(docs, words, percent)
    known = found.groupBy(F.col("node").alias("doc_id")).agg(F.min("component").alias("component_id"))
    joined = made.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the least of their component, with their columns; of repeated rows the first by text and columns."""
    made, found = linked(docs, words, percent)
    own = fresh("copy", docs.columns)
    copies = cut(found.groupBy("node").agg(F.min("component").alias("component")).where("node != component").select(F.col("node").alias("doc_id")))
    again = cut(made.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))

    def among(ids: DataFrame, how: str) -> DataFrame:
        return docs.join(few_or_joined(ids.select(F.col("doc_id").alias(own)), FEW_IDS), F.col("doc_id").cast("long") == F.col(own), how)

    kept = among(copies, "left_anti")
    if again.isEmpty():
        return kept
    docs = kept
    return among(again, "left_anti").unionByName(among(again, "left_semi").dropDuplicates(["doc_id", "text"]))
