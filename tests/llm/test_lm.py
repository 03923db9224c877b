import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from marlstone.llm import exchange, lm


class Model:
    """Counts by dictionaries, and the probabilities of the module's docstring by recursion."""

    def __init__(self, texts, order=lm.ORDER):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for words in texts:
            stream = ["<begin>", *words]
            for n in range(1, order + 1):
                self.counts[n].update(tuple(stream[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(stream)))
        one = self.counts[1]
        self.n, self.v = sum(one.values()), len(one)
        once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
        self.cut = min(max(once / max(1, once + 2 * twice), 0.05), 0.95)
        self.k = [0.0] + [self.fitted(n) for n in range(1, order)]

    def fitted(self, n):
        groups = {}
        for c in self.counts[n].values():
            number, mass = groups.get(int(math.log2(c)), (0, 0))
            groups[int(math.log2(c))] = number + 1, mass + c
        number, mass = (np.array([g[i] for g in groups.values()], float) for i in (0, 1))
        return lm.strength(sum(c == 1 for c in self.counts[n + 1].values()), number, mass)

    def p(self, word, history):
        if not history:
            c = self.counts[1][word,]
            return (c - self.cut if c else self.cut * self.v) / self.n
        seen = self.counts[1]["<end>",] if history == ("<begin>",) else self.counts[len(history)][history]
        k = self.k[len(history)]
        return (self.counts[len(history) + 1][*history, word] + k * self.p(word, history[1:])) / (seen + k)

    def score(self, words):
        stream = ["<begin>", *words]
        return sum(math.log10(self.p(stream[i], tuple(stream[max(0, i - self.order + 1) : i]))) for i in range(1, len(stream)))


def brute(rows, order=lm.ORDER):
    held = [crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    words = [[*(t or "").encode().lower().split(), "<end>"] for _, t in rows]
    model = Model([w for w, h in zip(words, held) if not h], order)
    out = []
    for h, w in zip(held, words):
        known = [model.counts[1][x,] for x in w]
        base = sum(math.log10((c + 1) / (model.n + model.v + 1)) for c in known) if model.n else 0.0
        out.append((h, len(w), sum(c > 0 for c in known), model.n, base, model.score(w) if model.n else 0.0))
    return out


def check(df, rows, order=lm.ORDER):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in lm.score_documents(df, order).collect())
    want = sorted((d if d is not None else -1, h, n, k, t, round(b, 4), round(s, 4)) for (d, _), (h, n, k, t, b, s) in zip(rows, brute(rows, order)))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=2e-3)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_brute_force(documents, rows, order):
    check(documents, rows, order)


def test_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check(odd_documents, rows)
    assert lm.score_documents(no_documents).count() == 0


def test_next_words_sum_to_one(spark):
    """Over all known words, the end and one unknown word, the probabilities after every history add up to one."""
    texts = ["a b a c", "a b b", "c a b"]
    ids = [d for d in range(50) if crc32(str(d).encode()) % 7 != 2][: len(texts)]
    probes = [d for d in range(100, 400) if crc32(str(d).encode()) % 7 == 2]
    histories = ["", "a", "b", "a b", "b b", "c a", "zzz", "b zzz", "zzz a"]
    made = iter(probes)
    asked = {next(made): f"{h} {w}".strip() for h in histories for w in ("a", "b", "c", "zzz", "")}
    df = spark.createDataFrame([*zip(ids, texts), *asked.items()], "doc_id long, text string")
    got = {asked[r.doc_id]: r.score for r in lm.score_documents(df).collect() if r.doc_id in asked}
    model = Model([[*t.encode().split(), "<end>"] for t in texts])
    for h in histories:
        stream = ["<begin>", *h.encode().split()]
        past = sum(math.log10(model.p(stream[i], tuple(stream[max(0, i - 2) : i]))) for i in range(1, len(stream)))
        end = got[h] - past  # the text of the history alone goes on with its end
        total = 10**end
        for w in ("a", "b", "c", "zzz"):
            after = math.log10(model.p("<end>", tuple([*stream, w.encode()][-2:])))
            total += 10 ** (got[f"{h} {w}".strip()] - past - after)
        assert total == pytest.approx(1, abs=1e-6), h


def test_strength_expects_as_many_new_tokens_as_there_are():
    number, mass = np.array([50, 20, 0, 3]), np.array([50, 50, 0, 900])
    k = lm.strength(200, number, mass)
    mean = mass[[0, 1, 3]] / number[[0, 1, 3]]
    assert (mass[[0, 1, 3]] * k / (mean + k)).sum() == pytest.approx(200)
    assert lm.strength(0, number, mass) > 0 and lm.strength(10**9, number, mass) < 1e12


def test_longer_histories_fit_held_out_texts_better(documents):
    """Mean log10 probability of a held-out token."""
    cost = []
    for order in (1, 2, 3):
        rows = lm.score_documents(documents, order).where("held_out").collect()
        cost.append(sum(r.score for r in rows) / sum(r.n_tokens for r in rows))
    base = sum(r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert base < cost[0] < cost[1] and cost[2] > cost[1] - 0.05


def test_lanes_of_long_texts_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 30, n))) for i, n in enumerate((0, 1, 2, 5000, 511, 512, 513, 700))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_keys_and_numbers_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (2**64 - 1, 2**56, 5000):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (exchange.unpack_keys(exchange.pack_keys(keys)) == keys).all()
