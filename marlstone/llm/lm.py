"""Scoring texts with a weighted back-off automaton of smoothed n-grams.

The states are the histories (none, one or two words) that occur in the training texts; the root is the
empty history.  A state has an arc for every word seen after it, and a failure arc to the state of its
history without the first word.  With c the training counts, the weights are those of

    p(w)     = (c(w) - D) / N for known words, D V / N together for all unknown ones
    p(w | h) = (c(h w) + K p(w | h without its first word)) / (c(h) + K)

so an arc has log p(w | h), a failure arc log K / (c(h) + K), and the root has an arc for every known word
and one for all unknown ones.  D = n1 / (n1 + 2 n2), from the words seen once and twice.  K, one for each
length of history, is fitted on all training texts by leaving one out: a token is new after its history if
its n-gram was seen once, and K is such that the failure arcs expect as many new tokens as there are.

Reading a text from left to right carries a state: where it has an arc for the word, its weight is added
and the arc's end is the next state; if not, the failure arc's weight is added, and its end tries.  The
texts of a block are walked side by side, long ones in lanes that begin with the words that fix the state.

The corpus of n-grams has no bound, so the automaton is never held in one place: counts are gathered
by hash (see ``exchange``), and every block of texts gets exactly the arcs and states that it can meet.

Defined results: a null or empty text is its end token alone; texts of any length are scored as a whole;
repeated rows count and score once each; without training texts N and V are 0 and both scores are 0; a
null id is the empty text for the fold; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, coded_words, crc_mod, cut, mixed
from .exchange import NO_DOC, answered, asked, bucket_slices, checksum, many_buckets, numbered, pack_keys, pack_numbers, payload, unpack_keys, unpack_numbers, unpack_payload

OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
REQUEST = "bucket int, block long, checksum long, kind int, keys binary, counts binary"
ANSWER = "block long, checksum long, kind int, bucket int, counts binary, sums array<long>"
ANSWERED = ["block", "checksum", "kind", "bucket", "counts", "sums"]
#: Length of the n-grams, bits of their hashes, and tokens of a lane.
ORDER, BITS, LANE = 3, 56, 512
BLOCK = 9_000_000
BEGIN, END = 0, 1
BEGIN_KEY, END_KEY = U64(0x1D8E4E27C47D124F), U64(0xEB44ACCAB455D165)
ODD = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]
#: Sums over the n-grams of a bucket: all, distinct, seen once, seen twice; then for each binary magnitude of the count how many and all.
TOTAL, TYPES, ONCE, TWICE, MAGNITUDES = 0, 1, 2, 3, 48
SUMS = 4 + 2 * MAGNITUDES


class Grams:
    """N-grams of a block: for each length the sorted distinct keys, and which one ends at each token (-1: none)."""

    def __init__(self, texts: list[bytes], order: int):
        words, which, edges = coded_words(pa.array(texts, pa.string()))
        sizes = np.diff(edges)
        self.starts = np.cumsum(sizes + 2) - (sizes + 2)
        tokens = np.full(len(which) + 2 * len(texts), END, np.int32)
        tokens[np.arange(len(which)) + 2 * np.repeat(np.arange(len(texts)), sizes) + 1] = which + 2
        tokens[self.starts] = BEGIN
        key_of = np.array([BEGIN_KEY, END_KEY, *(xxhash.xxh3_64_intdigest(w) for w in words)], np.uint64)
        self.real = tokens != BEGIN  # the begin mark is a history, never predicted
        self.doc = (np.cumsum(~self.real) - 1).astype(np.int32)
        keys = word_keys = key_of[tokens]
        self.keys, self.which = [], []
        place = np.arange(len(tokens)) - self.starts[self.doc]
        for n in range(1, order + 1):
            if n > 1:
                keys = mixed(np.concatenate([keys[:1], keys[:-1]]) * ODD[(n - 2) % 3] + word_keys)
            whole = self.real & (place >= n - 1)
            found, where = np.unique(keys[whole] >> U64(64 - BITS), return_inverse=True)
            which = np.full(len(tokens), -1, np.int32)
            which[whole] = where
            self.keys.append(found)
            self.which.append(which)


def requests(source: DataFrame, order: int, buckets: int) -> DataFrame:
    """Distinct n-grams of every block and how often its training texts have them."""

    def ask(batches):
        for block, _, held, texts in numbered(batches, BLOCK):
            grams, check = Grams(texts, order), checksum(texts)
            trained = held[grams.doc] == 0
            for n in range(1, order + 1):
                keys, which = grams.keys[n - 1], grams.which[n - 1]
                counts = np.bincount(which[(which >= 0) & trained], minlength=len(keys))
                edges = bucket_slices(keys, buckets, BITS)
                spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
                columns = [
                    pa.array([b for b, _, _ in spans], pa.int32()),
                    pa.array([block] * len(spans), pa.int64()),
                    pa.array([check] * len(spans), pa.int64()),
                    pa.array([n] * len(spans), pa.int32()),
                    pa.array([pack_keys(keys[lo:hi]) for _, lo, hi in spans], pa.binary()),
                    pa.array([pack_numbers(counts[lo:hi]) for _, lo, hi in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "checksum", "kind", "keys", "counts"])

    return source.mapInArrow(ask, REQUEST)


def sums_of(totals: np.ndarray) -> np.ndarray:
    """What the weights need to know of the counts of distinct n-grams."""
    seen = totals[totals > 0]
    size = np.minimum(np.frexp(seen.astype(np.float64))[1] - 1, MAGNITUDES - 1)
    of_size = [np.bincount(size, minlength=MAGNITUDES), np.bincount(size, seen, MAGNITUDES)]
    return np.concatenate([[seen.sum(), len(seen), (seen == 1).sum(), (seen == 2).sum()], *of_size]).astype(np.int64)


def total_counts(rows: list[dict]):
    """Corpus counts of the n-grams of one bucket and length, for each request, and the bucket's sums."""
    keys = [unpack_keys(r["keys"]) for r in rows]
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, np.concatenate([unpack_numbers(r["counts"]) for r in rows]), len(found)).astype(np.int64)
    sums = sums_of(totals)
    ends = np.cumsum([len(k) for k in keys])
    own = {"kind": rows[0]["kind"], "bucket": rows[0]["bucket"]}
    out = [(r["block"], r["checksum"], own["kind"], own["bucket"], pack_numbers(totals[where[e - len(k) : e]])) for r, k, e in zip(rows, keys, ends)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([sums.tolist(), *[None] * (len(rows) - 1)], pa.list_(pa.int64()))], ANSWERED)


def strength(once: int, number: np.ndarray, mass: np.ndarray) -> float:
    """The K with which histories of the given numbers and masses of counts expect ``once`` new tokens."""
    seen = number > 0
    mean = mass[seen] / number[seen]
    if not len(mean):
        return 1.0
    goal = min(max(once, 0.001 * mass.sum()), 0.999 * mass.sum())
    low, high = 1e-9, 1e12
    for _ in range(100):
        k = (low * high) ** 0.5
        low, high = (k, high) if (mass[seen] * k / (mean + k)).sum() < goal else (low, k)
    return low


class Automaton:
    """The states and arcs that a block can meet.

    States are 0 for the root, then the block's n-grams of each length below ``order`` as histories; an
    arc is the block's n-gram of a state's history and a word.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], sums: np.ndarray):
        order = len(counts)
        self.order, self.grams = order, grams
        tokens, types, once, twice = (int(x) for x in sums[0, :4])
        cut = min(max(once / max(1, once + 2 * twice), 0.05), 0.95)
        self.arcs = [c > 0 for c in counts]
        self.base = np.log10((counts[0] + 1) / (tokens + types + 1))
        p = [np.where(counts[0] > 0, counts[0] - cut, cut * types) / tokens]
        first = np.cumsum([1, *(len(c) for c in counts[:-1])])  # the first state of each length of history
        self.first = first
        size = int(first[-1])
        self.fail_state, self.fail = np.zeros(size, np.int64), np.zeros(size)
        ended = counts[0][np.searchsorted(grams.keys[0], END_KEY >> U64(64 - BITS))]  # as often as texts began
        own_k = [strength(int(sums[n, ONCE]), *sums[n - 1, 4:].reshape(2, MAGNITUDES)) for n in range(1, order)]
        at = [np.zeros(len(c), np.int64) for c in counts]  # a token that each n-gram ends at
        for n, which in enumerate(grams.which):
            at[n][which[which >= 0]] = np.nonzero(which >= 0)[0]
        # weights of the arcs of longer n-grams, and the failure arcs of the states that they leave
        for n in range(1, order):
            history = at[n] - 1
            shorter = grams.which[n - 1][at[n]]
            known = grams.which[n - 1][history]
            c_h = np.where(known >= 0, counts[n - 1][known], ended if n == 1 else 0) if len(known) else np.zeros(0)
            p.append((counts[n] + own_k[n - 1] * p[n - 1][shorter]) / (c_h + own_k[n - 1]))
        for n in range(1, order):  # histories of n words
            states = slice(first[n - 1], first[n])
            self.fail[states] = np.log10(own_k[n - 1] / (counts[n - 1] + own_k[n - 1]))
            if n > 1:
                self.fail_state[states] = first[n - 2] + grams.which[n - 2][at[n - 1]]
        self.weight = [np.log10(x) for x in p]
        # where the arcs of each length lead: the longest history that is a state
        self.to = []
        for n in range(order):
            if n + 1 < order:
                self.to.append(first[n] + np.arange(len(counts[n])))
            else:
                self.to.append(first[n - 1] + grams.which[n - 1][at[n]] if n else np.zeros(len(counts[0]), np.int64))
        self.length = np.repeat(np.arange(order), np.diff([0, *first]))  # words of each state's history
        # the begin mark is a state of one word that fails to the root; it follows the others
        self.begin = size
        self.fail_state, self.fail = np.append(self.fail_state, 0), np.append(self.fail, np.log10(own_k[0] / (ended + own_k[0])) if order > 1 else 0.0)
        self.length = np.append(self.length, min(1, order - 1))

    def walk(self) -> np.ndarray:
        """Log10 weights at each token, from left to right with a state for each lane."""
        grams, n_tokens = self.grams, len(self.grams.real)
        out = np.zeros(n_tokens)
        sizes = np.diff(np.append(grams.starts, n_tokens))
        per = -(-sizes // LANE)  # lanes of a text
        turn = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = np.repeat(grams.starts, per) + turn * LANE
        stop = np.minimum(start + LANE, np.repeat(grams.starts + sizes, per))
        lead = np.where(turn > 0, start - np.minimum(self.order, turn * LANE), start)  # a text's first lane begins at its begin mark
        state = np.zeros(len(start), np.int64)
        at = lead.copy()
        live = np.arange(len(start))
        while len(live):
            tok, s = at[live], state[live]
            mark = ~grams.real[tok]
            s[mark] = self.begin
            score = np.zeros(len(live))
            seeking = ~mark
            for n in range(self.order - 1, -1, -1):  # arcs of states with histories of n words
                here = np.nonzero(seeking & (self.length[s] == n))[0]
                if not len(here):
                    continue
                gram = grams.which[n][tok[here]]
                arc = (gram >= 0) & (self.arcs[n][gram] if n else True)  # the root's arc for an unknown word counts for all
                found, lost = here[arc], here[~arc]
                gram = gram[arc]
                score[found] += self.weight[n][gram]
                known = self.arcs[n][gram]
                s[found] = np.where(known, self.to[n][gram], 0)
                seeking[found] = False
                score[lost] += self.fail[s[lost]]
                s[lost] = self.fail_state[s[lost]]
            state[live] = s
            own = tok >= start[live]
            out[tok[own]] = score[own]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


def scores(grams: Grams, counts: list[np.ndarray], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base and automaton log10 scores of each text."""
    if not sums[0, TOTAL]:
        zero = np.zeros(len(grams.starts))
        return zero, zero, zero
    automaton = Automaton(grams, counts, sums)
    word = grams.which[0]
    known = (counts[0] > 0)[word] & grams.real
    base = np.where(grams.real, automaton.base[word], 0)
    return tuple(np.add.reduceat(x.astype(np.float64), grams.starts) for x in (known, base, automaton.walk()))


def score_documents(docs: DataFrame, order: int = ORDER, fold: int = 7, held: int = 2) -> DataFrame:
    """Score every text by the n-grams of the texts outside the held-out fold."""
    source = asked(docs, (crc_mod(F.col("doc_id"), fold) == held).cast("int"))
    answers = cut(answered(requests(source, order, many_buckets(source)), total_counts, ANSWER))
    sums = np.zeros((order, SUMS), np.int64)  # a hundred numbers for each length, whatever the corpus
    for r in answers.where("sums is not null").groupBy("kind").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(SUMS)]).alias("n")).collect():
        sums[r.kind - 1] = r.n
    answers = answers.drop("sums")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        rows = right.to_pylist()
        for row in left.to_pylist():
            ids, flags, texts = unpack_payload(row)
            mine = sorted((r for r in rows if r["checksum"] == row["checksum"]), key=lambda r: r["bucket"])
            grams = Grams(texts, order)
            counts = [np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(r["counts"]) for r in mine if r["kind"] == n)]) for n in range(1, order + 1)]
            if [len(c) for c in counts] != [len(k) for k in grams.keys]:
                raise RuntimeError(f"block {row['block']} was read differently when it asked")
            known, base, value = scores(grams, counts, sums)
            n_tokens = np.diff(np.append(grams.starts, len(grams.doc))) - 1
            out.append(pa.table([pa.array([None if d == NO_DOC else int(d) for d in ids], pa.int64()), pa.array(flags == 1), pa.array(n_tokens, pa.int64()), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), sums[0, TOTAL]), pa.int64()), pa.array(base), pa.array(value)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        if not out:
            raise RuntimeError("answers without their block")
        return pa.concat_tables(out)

    return payload(source, BLOCK).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, OUT)
