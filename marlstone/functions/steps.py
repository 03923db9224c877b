"""Steps of a trace and their redundancy."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, is_ascii, lines, once, strip

SENTENCE = rf"(?<=[.!?]){WS}+"
VARIANTS = ("max", "mean_pairwise", "dup_fraction")
_TERM = re.compile(r"\b\w\w+\b")
_ROWS = 512


def split_steps(trace: Column, every_sentence: bool = False) -> Column:
    """Lines without the answer line; a lone line is split into its sentences, or every line on demand."""
    kept = F.filter(lines(F.coalesce(trace, F.lit(""))), lambda s: ~F.startswith(s, F.lit("####")))

    def sentences(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, SENTENCE), strip), lambda s: s != "")

    if every_sentence:
        return F.flatten(F.transform(kept, sentences))
    def divided(kept: Column) -> Column:
        alone = once(sentences(F.get(kept, 0)), lambda found: F.when(F.size(found) > 1, found).otherwise(kept))
        return F.when(F.size(kept) == 1, alone).otherwise(kept)

    return once(kept, divided)


def redundancy_of(steps: list[str], variant: str, threshold: float) -> float:
    """1 less the repetition among steps, by cosines of TF-IDF vectors fitted on these steps."""
    n = len(steps)
    if n < 2:
        return 1.0
    number: dict[str, int] = {}
    rows, cols = [], []
    for i, step in enumerate(steps):
        for term in _TERM.findall(step.lower()):
            rows.append(i), cols.append(number.setdefault(term, len(number)))
    if not number:  # no terms anywhere: all steps are unlike
        return 1.0
    tf = np.zeros((n, len(number)), np.float64)
    np.add.at(tf, (rows, cols), 1.0)
    weights = tf * (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1)
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    weights /= np.where(norms == 0, 1.0, norms)
    repeated, total, most = 0, 0.0, 0.0
    for at in range(0, n, _ROWS):
        cos = weights[at : at + _ROWS] @ weights.T
        earlier = np.arange(n)[None, :] < np.arange(at, at + len(cos))[:, None]
        cos = np.where(earlier, cos, 0.0)
        best = cos.max(axis=1)
        repeated += int((best > threshold).sum())
        total += float(cos.sum())
        most = max(most, float(best.max()))
    if variant == "dup_fraction":
        return 1.0 - repeated / (n - 1)
    return max(0.0, 1.0 - (most if variant == "max" else total / (n * (n - 1) / 2)))


def step_terms(step: Column) -> Column:
    """The terms of a step: words of two characters or more, in lower case."""
    words = [F.regexp_extract_all(F.lower(step), F.lit(pattern), F.lit(0)) for pattern in ("[0-9a-z_]{2,}", r"(?U)\b\w\w+\b")]
    return F.when(is_ascii(step), words[0]).otherwise(words[1])


def dot(a: Column, b: Column) -> Column:
    """Dot product of two lists of terms (t) with weights (w)."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x["w"] * F.aggregate(b, F.lit(0.0), lambda found, y: F.when(y["t"] == x["t"], y["w"]).otherwise(found)))


def _kinds(bags: Column) -> Column:
    """The distinct bags of terms in order of first place: how often each occurs, and its TF-IDF unit vector over all bags."""

    def weight(bag: Column, term: Column) -> Column:
        tf = F.size(F.filter(bag, lambda x: x == term))
        df = F.size(F.filter(bags, lambda b: F.array_contains(b, term)))
        return tf * (F.log((1 + F.size(bags)) / (1 + df)) + 1)

    def unit(entries: Column) -> Column:
        norm = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))
        return once(norm, lambda length: F.transform(entries, lambda e: F.struct(e["t"].alias("t"), (e["w"] / length).alias("w"))))

    def kind(bag: Column) -> Column:
        entries = F.transform(F.array_distinct(bag), lambda t: F.struct(t.alias("t"), weight(bag, t).alias("w")))
        return F.struct(F.size(F.filter(bags, lambda b: b == bag)).alias("n"), once(entries, unit).alias("unit"))

    return F.transform(F.array_distinct(F.filter(bags, lambda b: F.size(b) > 0)), kind)


def _may_be_near(kinds: Column, n: Column, threshold: float) -> Column:
    """Whether two of the distinct bags of n steps may have a cosine above the threshold.

    Where no bag holds a term twice, a shared term weighs at most log((1 + n) / 3) + 1, as two steps or more have it, and any other at least 1, so the
    s terms that two bags share have at most s m / (s m + rest) of a vector's square, m that weight's square.
    """
    def most(bag: Column, s: Column) -> Column:
        m = F.pow(F.greatest(F.log((1 + n) / 3), F.lit(0.0)) + 1, 2)
        return s * m / (s * m + (F.size(bag) - s))

    def near(a: Column, b: Column) -> Column:
        return F.arrays_overlap(a, b) & once(F.size(F.array_intersect(a, b)), lambda s: most(a, s) * most(b, s) > threshold * threshold - 1e-9)

    repeats = F.exists(kinds, lambda b: F.size(F.array_distinct(b)) < F.size(b))
    pairs = F.transform(kinds, lambda b, i: F.exists(F.slice(kinds, 1, i), lambda a: near(a, b)))
    return repeats | F.array_contains(pairs, True)


def redundancy(steps: Column, variant: str = "dup_fraction", threshold: float = 0.90) -> Column:
    """1 less the repetition among the steps of a trace, by cosines of TF-IDF vectors fitted on these steps.

    Equal steps are compared once, so the work grows with the square of the different steps of one
    trace; ``operators.redundancy`` does the same for texts of any length by joins.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; one of {VARIANTS}")

    def earlier(kinds: Column, i: Column) -> Column:
        return F.slice(kinds, 1, i)

    def compared(kinds: Column) -> Column:
        n = F.size(steps)
        copies = F.aggregate(kinds, F.lit(0), lambda acc, k: acc + k["n"] - 1)
        best = F.transform(kinds, lambda k, i: F.aggregate(earlier(kinds, i), F.lit(0.0), lambda acc, o: F.greatest(acc, dot(k["unit"], o["unit"]))))
        if variant == "dup_fraction":
            repeated = F.size(F.filter(best, lambda b: b > threshold)) + (copies if threshold < 1 else 0)
            return 1.0 - repeated / (n - 1)
        if variant == "max":
            return F.greatest(F.lit(0.0), 1.0 - F.when(copies > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(best), F.lit(0.0))))
        across = F.transform(kinds, lambda k, i: F.aggregate(earlier(kinds, i), F.lit(0.0), lambda acc, o: acc + o["n"] * dot(k["unit"], o["unit"])) * k["n"] + k["n"] * (k["n"] - 1) / 2)
        return F.greatest(F.lit(0.0), 1.0 - F.aggregate(across, F.lit(0.0), lambda acc, x: acc + x) / (n * (n - 1) / 2))

    def of_bags(bags: Column) -> Column:
        exact = once(_kinds(bags), compared)
        if variant != "dup_fraction" or threshold >= 1:
            return exact
        return once(F.filter(bags, lambda b: F.size(b) > 0), lambda full: once(F.array_distinct(full), lambda kinds: F.when(_may_be_near(kinds, F.size(bags), threshold), exact).otherwise(1.0 - (F.size(full) - F.size(kinds)) / (F.size(bags) - 1))))

    bags = F.transform(steps, lambda s: F.sort_array(step_terms(s)))
    return F.when(F.coalesce(F.size(steps), F.lit(0)) < 2, F.lit(1.0)).otherwise(once(bags, of_bags))
