"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A forward pass adds up
the probabilities of all ways to cut a word into pieces; a text's score for a language is the sum over
its words.  The piece probabilities come from a few rounds of expectation maximisation on the words
of a bounded sample of labelled documents; each language is learnt by a task of its own, and the driver
sees no words, only a probability for each piece and language.

Defined results: ``und`` with score 0 if the text is null, has no letter or nothing could be learnt;
ties go to the language that is first in the alphabet; words of any length are learnt and scored;
repeated rows each get a row; an empty table gives no rows; columns beside ``doc_id``, ``text`` and
``lang`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, crc_mod, mixed, small_batches

OUT = "doc_id long, held_out boolean, lang_pred string, score double"
START = "▁"
#: Labelled documents that a language is learnt from, about.
SAMPLE_DOCS = 1500
DRAWS = 1 << 52
ROUNDS, FLOOR, UNKNOWN = 3, 0.01, 1e-9
#: ASCII letters in lower case; every other ASCII character parts words.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
STEP = U64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """The vocabulary by hash: ``slots`` says which hashes may occur, ``keys`` which do."""

    keys: np.ndarray
    slots: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        return cls.of(names)

    @classmethod
    def of(cls, names: list[str]) -> Pieces:
        keys = []
        for name in names:
            h = 0
            for c in name:
                h = (h * int(STEP) + ord(c) + 1) % (1 << 64)
            keys.append(h)
        found = np.unique(mixed(np.array(keys, np.uint64)))
        slots = np.zeros(1 << 20, bool)
        slots[(found >> U64(44)).astype(np.int64)] = True
        return cls(found, slots, max(map(len, names)))

    def matches(self, chars: np.ndarray):
        """For words of one length (rows of code points): end, length, rows and piece numbers."""
        m, n = chars.shape
        rolling = np.zeros((m, n), np.uint64)
        for size in range(1, min(self.longest, n) + 1):
            rolling = rolling[:, : n - size + 1] * STEP + chars[:, size - 1 :] + U64(1)
            h = mixed(rolling)
            row, at = np.nonzero(self.slots[(h >> U64(44)).astype(np.int64)])
            h = h[row, at]
            where = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            real = self.keys[where] == h
            yield size, row[real], at[real], where[real]


def by_length(words: list[str], most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and code points of words of one length, in bounded groups."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        which = np.nonzero(lengths == n)[0]
        for k in range(0, len(which), max(1, most // int(n) // 16)):
            part = which[k : k + max(1, most // int(n) // 16)]
            joined = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, joined.reshape(len(part), n).astype(np.uint64)


def forward(pieces: Pieces, chars: np.ndarray, probs: np.ndarray):
    """Forward sums (rescaled at each end) and their logs, shape words x ends x languages."""
    m, n = chars.shape
    langs = probs.shape[1]
    arcs: list[list] = [[] for _ in range(n + 1)]
    single = np.zeros((m, n), bool)
    for size, row, at, which in pieces.matches(chars):
        if size == 1:
            single[row, at] = True
        order = np.argsort(at + size, kind="stable")
        ends = (at + size)[order]
        edges = np.searchsorted(ends, np.arange(n + 2))
        for end in np.unique(ends):
            part = order[edges[end] : edges[end + 1]]
            arcs[end].append((size, row[part], which[part]))
    alpha = np.zeros((n + 1, m, langs))
    alpha[0] = 1
    logs = np.zeros((n + 1, m, langs))
    for end in range(1, n + 1):
        total = alpha[end]
        total += np.where(single[:, end - 1], 0, UNKNOWN)[:, None] * alpha[end - 1]
        for size, row, which in arcs[end]:
            weight = probs[which]
            back = alpha[end - size][row]
            if size > 1:
                back = back * np.exp(logs[end - size][row] - logs[end - 1][row])
            total[row] += back * weight
        logs[end] = logs[end - 1] + np.log(total)
        alpha[end] = 1
    return arcs, single, logs


def log_scores(pieces: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), probs.shape[1]))
    for part, chars in by_length(words):
        out[part] = forward(pieces, chars, probs)[2][-1]
    return out


def learn(pieces: Pieces, counts: dict[str, float]) -> np.ndarray:
    """Piece probabilities of one language from its word counts."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words])
    probs = np.full((len(pieces.keys), 1), 1 / len(pieces.keys))
    for _ in range(ROUNDS):
        got = np.zeros_like(probs)
        for part, chars in by_length(words):
            n = chars.shape[1]
            arcs, single, logs = forward(pieces, chars, probs)
            beta = np.full(logs.shape, -np.inf)
            beta[n] = 0
            for start in range(n - 1, -1, -1):
                step = np.where(single[:, start], -np.inf, np.log(UNKNOWN))[:, None] + beta[start + 1]
                beta[start] = np.logaddexp(beta[start], step)
                for end in range(start + 1, min(n, start + pieces.longest) + 1):
                    for size, row, which in arcs[end]:
                        if end - size == start:
                            beta[start][row] = np.logaddexp(beta[start][row], np.log(probs[which]) + beta[end][row])
            for end in range(1, n + 1):
                for size, row, which in arcs[end]:
                    share = np.exp(logs[end - size][row] + np.log(probs[which]) + beta[end][row] - logs[n][row]) * weight[part][row][:, None]
                    np.add.at(got, which, share)
        probs = (got + FLOOR) / (got + FLOOR).sum(axis=0)
    return probs[:, 0]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def as_word(raw: bytes) -> str:
    return START + raw.decode("utf-8", "replace").lower()


def sample_counts(training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame | None:
    """Word counts by language of about ``sample_docs`` documents a language, picked by a hash of their id."""
    sizes = {r.lang: r.n for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return None
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS))
    for lang, n in sorted(sizes.items()):
        keep = keep | ((F.col("lang") == lang) & (draw < int(DRAWS * min(1.0, sample_docs / n))))

    def count(batches):
        for batch in batches:
            got: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for w in words_of(text or b""):
                    got[lang, w] = got.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.binary()), pa.array(got.values(), pa.int64())], ["lang", "word", "n"])

    return training.where(keep).select("lang", "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS) -> tuple[Pieces, list[str], np.ndarray]:
    """The model; each language's words, those of the bounded sample, are learnt in one task."""
    pieces = Pieces.load(vocabulary)
    training = small_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    counted = sample_counts(training, sample_docs)
    if counted is None:
        return pieces, [], np.zeros((len(pieces.keys), 0))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary, whatever the corpus

    def learnt(rows: pa.Table) -> pa.Table:
        counts: dict[str, float] = {}
        for word, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist()):
            w = as_word(word)
            counts[w] = counts.get(w, 0.0) + n
        probs = learn(shared.value, counts)
        return pa.table({"lang": rows["lang"].slice(0, 1), "probs": pa.array([probs.tobytes()], pa.binary())})

    rows = sorted(counted.groupBy("lang").applyInArrow(learnt, "lang string, probs binary").collect(), key=lambda r: r.lang)  # a row a language
    found = {r.lang: np.frombuffer(r.probs) for r in rows}
    return pieces, list(found), np.stack(list(found.values()), axis=1) if found else np.zeros((len(pieces.keys), 0))


def scorer(model: tuple[Pieces, list[str], np.ndarray]):
    """A function from texts to their languages and posteriors."""
    pieces, langs, probs = model

    def score(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        ids: dict[bytes, int] = {}
        new = ids.setdefault
        tokens = [np.array([new(w, len(ids)) for w in words_of(t)] if t else [], np.int64) for t in texts]
        words = [as_word(w) for w in ids]
        letters = np.array([any(c.isalpha() for c in w[1:]) for w in words], bool)
        of_word = log_scores(pieces, words, probs) * letters[:, None] if langs and words else np.zeros((len(words), 1))
        pred, conf = [], []
        for t in tokens:
            if not langs or not len(t) or not letters[t].any():
                pred.append("und"), conf.append(0.0)
                continue
            total = of_word[t].sum(axis=0)
            share = np.exp(total - total.max())
            pred.append(langs[int(total.argmax())]), conf.append(float(1 / share.sum()))
        return pred, conf

    return score


def predict(docs: DataFrame, model: tuple[Pieces, list[str], np.ndarray]) -> DataFrame:
    """Language and posterior for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages, whatever the corpus

    def label(batches):
        score = scorer(shared.value)
        for batch, texts in blocks(batches):
            pred, conf = score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(conf, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return picked.mapInArrow(label, OUT)


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    return predict(docs, train(docs, vocabulary))


def accepted(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose language can be told with a posterior of at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, vocabulary))

    def sift(batches):
        score = scorer(shared.value)
        for batch, texts in blocks(batches):
            yield batch.filter(pa.array([p != "und" and c >= least for p, c in zip(*score(texts))], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
