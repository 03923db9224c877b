"""Category, complexity, operation, richness and surface features of a question, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import all_of
from .text import once, strip

# Keywords of each category; the last category with a hit counts.
CATEGORIES = {
    "arithmetic": ("add", "subtract", "multiply", "divide", "sum of", "difference of", "product of"),
    "logic": ("if ", "then ", "must ", "either ", "unless", "condition", "at least", "at most", "exactly"),
    "ratio": ("ratio", "proportion", "compared to", "for every", "out of", "fraction of"),
    "counting": ("how many", "count", "number of", "total number", "altogether", "in all", "combined"),
    "rate": (" per ", "each", "rate", "speed", "mph", "km/h", "miles per", "km per", "per hour", "per day", "per week", "per item"),
    "time": ("hour", "minute", "second", "day", "week", "month", "year", "o'clock", "am", "pm", "morning", "evening", "duration"),
    "monetary": ("dollar", "$", "cent", "cost", "price", "pay", "charge", "fee", "earn", "wage", "salary", "discount", "spend", "budget", "afford"),
    "percentage": ("percent", "%", "percentage", "out of 100", "per cent", "discount", "tax", "tip", "interest"),
}
# Order of the categories, words and patterns that the features look for.
CATEGORY_ORDER = ("percentage", "monetary", "time", "rate", "counting", "ratio", "logic", "arithmetic")
STEP_WORDS = ("then", "after", "also", "each", "total", "remaining", "left", "more", "less", "how many", "how much", "per")
NAMING = ("how many", "how much", "find", "we need", "what is", "total")
OPERATIONS = {
    "addition": r"(?i)(?<!\w)[+](?!\w)|add(?:ition|ed|s)\b",
    "subtraction": r"(?i)(?<!\w)[-](?!\w)|subtract(?:ed|s|ion)?\b|minus\b|less\b",
    "multiplication": r"(?i)[*×]|multipl(?:y|ied|ies|ication)\b|times\b|product\b",
    "division": r"(?i)[÷/]|divid(?:e|es|ed|ing|sion)\b|per\b",
}
CUES = {
    "cue_percent": r"(?i)%|percent|percentage",
    "cue_money": r"(?i)\$|dollar|cent|cost|price|pay|spend|buy|sell",
    "cue_ratio": r"(?i)\bratio\b|\bper\b|\brate\b|each|every",
    "cue_time": r"(?i)hour|minute|second|day|week|month|year|\bage\b",
    "cue_compare": r"(?i)more than|less than|fewer|greater|difference|twice|half|double",
    "cue_total": r"(?i)total|altogether|in all|combined|sum|remaining|left",
}
COMPLEXITY_STEPS = {"simple": 2, "medium": 4, "complex": 6}
WHOLE_NUMBER = r"\b[0-9]+(?:\.[0-9]+)?\b"
QUANTITY = r"(?<![\w.])[0-9][0-9,]*(?:\.[0-9]+)?(?:/[0-9]+)?"


def has(text: Column, word: str, word_boundaries: bool = False) -> Column:
    if word_boundaries and word.strip().isalpha():
        return text.rlike(rf"\b{word.strip()}\b")
    return F.contains(text, F.lit(word))


def category_type(question: Column, word_boundaries: bool = False) -> Column:
    def found(low: Column) -> Column:
        kind = F.lit("arithmetic")
        for name, words in CATEGORIES.items():
            kind = F.when(reduce(lambda a, b: a | b, [has(low, w, word_boundaries) for w in words]), name).otherwise(kind)
        return kind

    return once(F.lower(question), found)


def keyword_hits(question: Column, category: Column) -> Column:
    low = F.lower(question)
    found = F.array().cast("array<string>")
    for name, words in CATEGORIES.items():
        found = F.when(category == name, F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))).otherwise(found)
    return found


def estimated_steps(question: Column, solution: Column | None = None) -> Column:
    guess = F.greatest(F.lit(1), F.floor(F.regexp_count(question, F.lit(WHOLE_NUMBER)) / 2).cast("int"))
    if solution is None:
        return guess
    worked = F.size(F.filter(F.split(solution, "\n"), lambda ln: ln.rlike(r"[0-9]\s*[+\-*/×÷]\s*[0-9]")))
    return F.when(F.coalesce(solution, F.lit("")) != "", worked).otherwise(guess)


def complexity(steps: Column) -> Column:
    return F.when(steps <= 3, "simple").when(steps <= 5, "medium").otherwise("complex")


def main_operation(text: Column) -> Column:
    counts = {name: F.regexp_count(text, F.lit(p)) for name, p in OPERATIONS.items()}
    most = F.greatest(*counts.values())
    ties = reduce(lambda a, b: a + b, [(c == most).cast("int") for c in counts.values()])
    named = F.when(most == 0, "none").when(ties > 1, "mixed")
    for name, c in counts.items():
        named = named.when(c == most, name)
    return named


def categorize(question: Column, solution: Column | None = None, word_boundaries: bool = False) -> Column:
    kind, steps = category_type(question, word_boundaries), estimated_steps(question, solution)
    text = F.concat(F.coalesce(solution, F.lit("")) if solution is not None else F.lit(""), F.lit(" "), question)
    return F.struct(kind.alias("category_type"), complexity(steps).alias("complexity"), main_operation(text).alias("main_operation"), steps.alias("estimated_steps"), keyword_hits(question, kind).alias("keyword_hits"))


def question_features(question: Column) -> dict[str, Column]:
    """Features of the question alone; neither answer nor solution is an input."""
    steps = estimated_steps(question)
    sentences = F.size(F.filter(F.split(question, r"[.!?]+\s+|\n+"), lambda s: strip(s) != ""))
    words = F.regexp_count(question, F.lit("[A-Za-z]+"))
    n_sentences = F.greatest(sentences, F.lit(1)).cast("double")
    return {
        "category_type": category_type(question),
        "main_operation": main_operation(F.concat(F.lit(" "), question)),
        "complexity": complexity(steps),
        "n_quantities": F.size(all_of(question, QUANTITY)).cast("double"),
        "n_tokens": words.cast("double"),
        "n_chars": F.length(question).cast("double"),
        "n_sentences": n_sentences,
        "avg_sent_len": words / n_sentences,
        "est_steps_qfree": steps.cast("double"),
        **{name: question.rlike(p).cast("double") for name, p in CUES.items()},
    }


def richness(question: Column) -> Column:
    """How good an example a question makes: length, numbers and words of several steps; four places."""
    low, n = F.lower(question), F.length(question)
    by_length = F.when(n < 40, F.lit(0.3)).when(n <= 200, F.lit(1.0)).otherwise(F.greatest(F.lit(0.4), F.lit(1.0) - (n - 200) / F.lit(500.0)))
    numbers = F.least(F.lit(1.0), F.regexp_count(question, F.lit(WHOLE_NUMBER)) / F.lit(5.0))
    hits = once(low, lambda text: reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in STEP_WORDS]))
    return F.round(F.lit(0.35) * by_length + F.lit(0.35) * numbers + F.lit(0.30) * F.least(F.lit(1.0), hits / F.lit(3.0)), 4)


def names_target(question: Column, trace: Column) -> Column:
    text = F.lower(F.concat(question, F.lit(" "), F.coalesce(trace, F.lit(""))))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in NAMING])
