"""Exact removal of repeated 100-byte strings with a sparse, range-partitioned suffix array.

Sorting every suffix of the corpus is not affordable, and not needed: of the 69 grams of 32 bytes in
a window of 100 bytes the one with the least hash is the window's anchor, and equal windows have equal
anchors at equal places.  So only suffixes at anchors are looked at:

1. every block sends the hash of each distinct anchor gram and of its context (the bytes of all windows
   that have this anchor) to hash buckets, which tell apart anchors that occur once, anchors whose whole
   context occurred before, and anchors that occur in several contexts;
2. the suffixes at anchors of the last kind, once for each context, are range-partitioned by their
   leading 32 bytes at splitters that Spark samples; each part is sorted by multikey sorting, eight bytes
   at a time, to the right of the anchor and, reversed, to its left; neighbours' common prefixes then
   tell which windows are equal, and all but the first are repeated.  Suffixes with the same leading
   bytes are never parted, so no comparison across a splitter is left over - except that leads with more
   than ``HEAVY`` suffixes are taken out and compared window by window in an aggregation, which parts
   them at will;
3. every block removes what its repeated windows cover.

Order is by (doc_id, start); equal ids go by their place in the input.

Defined results: a null text is empty; texts of fewer than 100 bytes keep everything; texts of any length are
looked at as a whole; a null id comes first and is returned as null; repeated rows are later copies and lose
whatever the first has; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, mixed, partitions
from .exchange import NO_DOC, answered, asked, bucket_slices, checksum, many_buckets, numbered, pack_keys, pack_numbers, payload, unpack_keys, unpack_numbers, unpack_payload

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
REQUEST = "bucket int, block long, checksum long, kind int, keys binary, contexts binary, docs binary"
ANSWER = "block long, checksum long, bucket int, codes binary"
FOUND = "block long, kind int, rows binary, starts binary, ends binary, row int, doc_id long, lead binary, at int, start long, body binary"
SPANS = "block long, rows binary, starts binary, ends binary"
WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM
#: Suffixes with one lead that a task sorts; more are compared by aggregation.
HEAVY = 20_000
BLOCK, CHUNK, PLACE = 3_000_000, 1 << 16, 17
ONCE, REPEATED, SEVERAL = 0, 1, 2
BASE = 0x9E3779B97F4A7C15
SIGN = U64(1 << 63)
OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
ODD = [U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5), U64(0x85EBCA77C2B2AE63)]


def power(n: int) -> np.uint64:
    return U64(pow(BASE, n, 1 << 64))


class Anchors:
    """Anchors of a block: first and last window, place, gram and context hash, by place."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        whole = np.frombuffer(b"".join(texts), np.uint8)
        n = len(whole)
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for base in range(0, max(0, n - WINDOW + 1), CHUNK):
            stop = min(n, base + CHUNK + WINDOW - 1)
            h = OF_BYTE[whole[base:stop]]
            sums = {1: h}
            for size in (1, 2, 4, 8, 16, 32):
                sums[2 * size] = sums[size][:-size] * power(size) + sums[size][size:]
            count = stop - base - WINDOW + 1
            full = sums[64][:count] * power(36) + sums[32][64 : 64 + count] * power(4) + sums[4][96 : 96 + count]
            gram = mixed(sums[GRAM])
            least = (gram >> U64(PLACE) << U64(PLACE)) | np.arange(len(gram), dtype=np.uint64)
            for size in (1, 2, 4, 8, 16, 32):
                least = np.minimum(least[:-size], least[size:])
            least = np.minimum(least[: -(REACH + 1 - 64)], least[REACH + 1 - 64 :])[:count]
            place = (least & U64((1 << PLACE) - 1)).astype(np.int64) + base
            start = np.arange(base, base + count)
            inside = start + WINDOW <= (self.offsets + self.lengths)[np.searchsorted(self.offsets, start, "right") - 1]
            place = np.where(inside, place, -1)
            edge = np.nonzero(np.diff(place, prepend=-2))[0]
            last = np.append(edge[1:], count) - 1
            real = place[edge] >= 0
            edge, last = edge[real], last[real]
            at = place[edge]
            for column, value in zip(parts, (edge + base, last + base, at, gram[at - base], full[edge], full[last])):
                column.append(value)
        lo, hi, at, gram, first, final = (np.concatenate([np.zeros(0, np.int64 if k < 3 else np.uint64), *p]) for k, p in enumerate(parts))
        new = np.diff(at, prepend=-1) != 0  # an anchor's windows may lie in two chunks
        end = np.append(np.nonzero(new)[0][1:], len(at)) - 1 if len(at) else np.zeros(0, np.int64)
        self.lo, self.hi, self.at = lo[new], hi[end], at[new]
        self.gram = mixed(gram[new] * ODD[0])  # the least hashes of windows are small numbers; buckets need even ones
        self.row = np.searchsorted(self.offsets, self.at, "right") - 1
        shape = (self.at - self.lo).astype(np.uint64) * ODD[2] + (self.hi - self.lo).astype(np.uint64) * ODD[3]
        self.context = mixed(first[new] * ODD[0] + final[end] * ODD[1] + shape) >> U64(16)

    def pairs(self, docs: np.ndarray):
        """Anchors by gram, context and order; which of them are the first of their gram and context."""
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((np.arange(len(docs)), docs))] = np.arange(len(docs))
        order = np.lexsort((self.at, rank[self.row], self.context, self.gram))
        gram, context = self.gram[order], self.context[order]
        first = np.ones(len(order), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        return order, first


def requests(source: DataFrame, buckets: int) -> DataFrame:
    def ask(batches):
        for block, docs, _, texts in numbered(batches, BLOCK):
            anchors, check = Anchors(texts), checksum(texts)
            order, first = anchors.pairs(docs)
            which = order[first]
            keys = anchors.gram[which]
            contexts = anchors.context[which].view(np.uint8).reshape(-1, 8)[:, :6]
            ids = docs[anchors.row[which]].view(np.uint64) ^ SIGN
            edges = bucket_slices(keys, buckets)
            spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
            columns = [
                pa.array([b for b, _, _ in spans], pa.int32()),
                pa.array([block] * len(spans), pa.int64()),
                pa.array([check] * len(spans), pa.int64()),
                pa.array([0] * len(spans), pa.int32()),
                pa.array([pack_keys(keys[lo:hi]) for _, lo, hi in spans], pa.binary()),
                pa.array([contexts[lo:hi].tobytes() for _, lo, hi in spans], pa.binary()),
                pa.array([pack_numbers(ids[lo:hi]) for _, lo, hi in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "checksum", "kind", "keys", "contexts", "docs"])

    return source.mapInArrow(ask, REQUEST)


def tell_apart(rows: list[dict]):
    """For each anchor of one bucket's requests: once, repeated or in several contexts."""
    keys = [unpack_keys(r["keys"]) for r in rows]
    sizes = [len(k) for k in keys]
    gram = np.concatenate(keys)
    wide = np.zeros((len(gram), 8), np.uint8)
    wide[:, :6] = np.frombuffer(b"".join(r["contexts"] for r in rows), np.uint8).reshape(-1, 6)
    context = wide.reshape(-1).view(np.uint64)
    doc = np.concatenate([unpack_numbers(r["docs"]) for r in rows]).view(np.uint64)
    turn = np.repeat(np.arange(len(rows)), sizes)  # rows come by block
    order = np.lexsort((turn, doc, context, gram))
    g, c = gram[order], context[order]
    new_gram, new_pair = np.ones(len(g), bool), np.ones(len(g), bool)
    new_gram[1:] = g[1:] != g[:-1]
    new_pair[1:] = new_gram[1:] | (c[1:] != c[:-1])
    group = np.cumsum(new_gram) - 1
    several = np.bincount(group, new_pair)[group] > 1
    codes = np.empty(len(g), np.int64)
    codes[order] = np.where(new_pair, np.where(several, SEVERAL, ONCE), REPEATED)
    ends = np.cumsum(sizes)
    columns = [[r["block"] for r in rows], [r["checksum"] for r in rows], [r["bucket"] for r in rows], [pack_numbers(codes[e - n : e]) for e, n in zip(ends, sizes)]]
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["block", "checksum", "bucket", "codes"])


def packed(values) -> bytes:
    return pack_numbers(np.asarray(values, np.int64))


def sort_out(left: pa.Table, right: pa.Table) -> pa.Table:
    """Repeated spans of a block, and the suffixes that need to be sorted."""
    out: list[tuple] = []
    answers = right.to_pylist()
    for row in left.to_pylist():
        docs, _, texts = unpack_payload(row)
        anchors = Anchors(texts)
        order, first = anchors.pairs(docs)
        mine = sorted((r for r in answers if r["checksum"] == row["checksum"]), key=lambda r: r["bucket"])
        codes = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(r["codes"]) for r in mine)])
        if len(codes) != first.sum():
            raise RuntimeError(f"block {row['block']} was read differently when it asked")
        code = np.full(len(order), REPEATED)
        code[order[first]] = codes
        again = code == REPEATED
        starts = anchors.lo - anchors.offsets[anchors.row]
        ends = anchors.hi - anchors.offsets[anchors.row] + WINDOW
        out.append((row["block"], 0, packed(anchors.row[again]), packed(starts[again]), packed(ends[again]), None, None, None, None, None, None))
        for k in np.nonzero(code == SEVERAL)[0].tolist():
            r, at, start = int(anchors.row[k]), int(anchors.at[k] - anchors.lo[k]), int(starts[k])
            body = texts[r][start : int(ends[k])]
            doc = int(docs[r])
            out.append((row["block"], 1, None, None, None, r, None if doc == NO_DOC else doc, body[at : at + GRAM], at, start, body))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of bytes eight bytes at a time, going on only where they tie; neighbours' common prefixes."""
    m, width = rows.shape
    words = np.zeros((m, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order, group = np.arange(m), np.zeros(m, np.int64)
    tied = np.arange(m)
    for column in range(words.shape[1]):
        if not len(tied):
            break
        own = order[tied]
        inner = np.lexsort((words[own, column], group[tied]))
        own, tied_group = own[inner], group[tied][inner]
        order[tied] = own
        w = words[own, column]
        new = np.ones(len(own), bool)
        new[1:] = (tied_group[1:] != tied_group[:-1]) | (w[1:] != w[:-1])
        first_of = np.maximum.accumulate(np.where(new, tied, 0))
        group[tied] = first_of
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
    common = np.zeros(m, np.int64)
    for k in range(1, m, 1 << 16):
        a, b = rows[order[k - 1 : min(m, k + (1 << 16)) - 1]], rows[order[k : k + (1 << 16)]]
        differ = a != b
        common[k : k + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def repeated(bodies: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in document order: the least and largest distance from the start of a repeated
    window to the anchor; -1 where none is repeated."""
    m = len(bodies)
    right, left = np.zeros((m, WINDOW), np.uint8), np.zeros((m, REACH), np.uint8)
    lengths = np.array([len(b) for b in bodies], np.int64)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum(lengths) - lengths
    for k in range(WINDOW):
        there = at + k < lengths
        right[there, k] = flat[(begin + at + k)[there]]
    for k in range(REACH):
        there = at - 1 - k >= 0
        left[there, k] = flat[(begin + at - 1 - k)[there]]
    order_r, common_r = multikey(right)
    order_l, common_l = multikey(left)
    least, most = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
    class_r, class_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for j in range(REACH + 1):
        valid = np.nonzero((at >= j) & (lengths - at >= WINDOW - j))[0]
        if len(valid) < 2:
            continue
        class_r[order_r] = np.cumsum(common_r < WINDOW - j)
        class_l[order_l] = np.cumsum(common_l < j)
        _, firsts = np.unique(class_r[valid] * (m + 1) + class_l[valid], return_index=True)
        again = np.ones(len(valid), bool)
        again[firsts] = False
        hit = valid[again]
        least[hit] = np.where(least[hit] < 0, j, least[hit])
        most[hit] = j
    return least, most


def by_suffixes(suffixes: DataFrame, parts: int) -> DataFrame:
    """Spans of repeated windows, from suffixes dealt by their leading bytes."""

    def sort(batches):
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        docs = np.array([NO_DOC if d is None else d for d in rows["doc_id"].to_pylist()], np.int64)
        block, row, start, at = (rows[c].to_numpy().astype(np.int64) for c in ("block", "row", "start", "at"))
        order = np.lexsort((start, row, block, docs))
        bodies = rows["body"].to_pylist()
        least, most = repeated([bodies[k] for k in order.tolist()], at[order])
        hit = least >= 0
        own = order[hit]
        begins, ends = (start + at)[own] - most[hit], (start + at)[own] - least[hit] + WINDOW
        by_block = np.argsort(block[own], kind="stable")
        edges = np.nonzero(np.diff(block[own][by_block], prepend=-1, append=-1))[0]
        parts = [by_block[a:b] for a, b in zip(edges[:-1], edges[1:])]
        columns = [[int(block[own][p[0]]) for p in parts], [packed(row[own][p]) for p in parts], [packed(begins[p]) for p in parts], [packed(ends[p]) for p in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), *[pa.binary()] * 3))], ["block", "rows", "starts", "ends"])

    picked = suffixes.select("block", "row", "doc_id", "lead", "at", "start", "body")
    return picked.repartitionByRange(parts, "lead").mapInArrow(sort, SPANS)


def by_windows(suffixes: DataFrame) -> DataFrame:
    """The same for leads with very many suffixes: the first place of every window by aggregation."""

    def explode(batches):
        for batch in batches:
            out = []
            for r in batch.select(["block", "row", "doc_id", "start", "body"]).to_pylist():
                out += [(r["block"], r["row"], r["doc_id"], r["start"] + k, hashlib.blake2b(r["body"][k : k + WINDOW], digest_size=16).digest()) for k in range(len(r["body"]) - WINDOW + 1)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "row", "doc_id", "start", "key"])

    windows = suffixes.mapInArrow(explode, "block long, row int, doc_id long, start long, key binary")
    place = F.struct(F.col("doc_id").isNotNull(), "doc_id", "block", "row", "start")
    firsts = windows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = windows.join(firsts, "key").where(place != F.col("first"))

    def spans(batches):
        for batch in batches:
            rows, starts = batch.column("row").to_pylist(), batch.column("start").to_pylist()
            columns = [batch.column("block"), pa.array([packed([r]) for r in rows], pa.binary()), pa.array([packed([s]) for s in starts], pa.binary()), pa.array([packed([s + WINDOW]) for s in starts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "rows", "starts", "ends"])

    return again.select("block", "row", "start").mapInArrow(spans, SPANS)


def remove(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block without the bytes of their spans."""
    out = []
    spans = right.to_pylist()
    for row in left.to_pylist():
        docs, _, texts = unpack_payload(row)
        lengths = np.array([len(t) for t in texts], np.int64)
        offsets = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        edge = np.zeros(n + 1, np.int32)
        for s in spans:
            base = offsets[unpack_numbers(s["rows"])]
            np.add.at(edge, base + unpack_numbers(s["starts"]), 1)
            np.add.at(edge, base + unpack_numbers(s["ends"]), -1)
        gone = np.cumsum(edge[:n], dtype=np.int32) > 0
        for doc, text, a, size in zip(docs.tolist(), texts, offsets.tolist(), lengths.tolist()):
            mine = gone[a : a + size]
            removed = int(mine.sum())
            kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if removed else text
            runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if removed else 0
            out.append((None if doc == NO_DOC else doc, size, removed, runs, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*out)) or [()] * 5
    kinds = (*[pa.int64()] * 4, pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """What is left of every text without its repeated strings, as sizes and a checksum."""
    spark = docs.sparkSession
    parts = partitions(spark)
    source = asked(docs)
    blocks = payload(source, BLOCK)
    answers = answered(requests(source, many_buckets(source)), tell_apart, ANSWER)
    found = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sort_out, FOUND))
    suffixes = found.where("kind = 1")
    crowded = suffixes.groupBy("lead").count().where(F.col("count") > heavy).select("lead")
    crowded_leads = crowded.count()
    light = suffixes.join(crowded, "lead", "left_anti") if crowded_leads else suffixes
    spans = found.where("kind = 0").select("block", "rows", "starts", "ends").unionByName(by_suffixes(light, parts))
    if crowded_leads:
        spans = spans.unionByName(by_windows(suffixes.join(crowded, "lead", "left_semi")))
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, OUT)
