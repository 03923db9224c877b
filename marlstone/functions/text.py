"""Text normalisation, trace truncation and small renderings as columns."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends as the Unicode standard has them, with the ASCII separators.
WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
ASCII_WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# Characters that normalisation folds.
SPACES = {" ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "﻿": ""}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "′": "'", "″": '"'}
VULGAR = {
    "½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5",
    "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
}
MATH = {"−": "-", "×": "*", "∗": "*", "÷": "/", "⁄": "/", "∕": "/", "＝": "=", "＋": "+"}
STOP_MARKERS = ("\nQuestion:", "\nQ:", "\nExample", "\nProblem:")
CODE_FENCE = "\\begin{code}"


_built: dict = {}


def built(name, make):
    """What ``make`` gives - columns that rest on names alone - made once an application: large expressions take
    longer to put together than to run on a small table."""
    context = SparkContext._active_spark_context
    if context is None:
        return make()
    key = context.applicationId, name
    if key not in _built:
        _built[key] = make()
    return _built[key]


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), 0)


def folded(text: Column, table: dict[str, str]) -> Column:
    """One-to-one replacements and deletions in one pass."""
    kept = [(k, v) for k, v in table.items() if v] + [(k, v) for k, v in table.items() if not v]
    return F.translate(text, "".join(k for k, _ in kept), "".join(v for _, v in kept))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def strip(text: Column) -> Column:
    return F.when(is_ascii(text), F.btrim(text, F.lit(ASCII_WS))).otherwise(F.regexp_replace(text, f"^{WS}+|{WS}+$", ""))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+$", "")


def clean_question(text: Column) -> Column:
    s = folded(folded(text, SPACES), QUOTES)
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return strip(s)


def normalize_math(text: Column, vulgar_spacing: bool = False) -> Column:
    """``vulgar_spacing`` keeps a digit before a vulgar fraction apart from it.

    Most texts are tidy ASCII and stay as they are.
    """
    if vulgar_spacing:
        return _folded_math(text, True)
    untidy = rf"[ \t]{{2}}|\n{{3}}|^{WS}|{WS}$"
    return F.when(is_ascii(text) & ~text.rlike(untidy), text).otherwise(_folded_math(text, False))


def _folded_math(text: Column, vulgar_spacing: bool) -> Column:
    s = clean_question(text)
    if vulgar_spacing:
        s = F.regexp_replace(s, f"(?<=[0-9])(?=[{''.join(VULGAR)}])", " ")
    for glyph, plain in VULGAR.items():
        s = F.replace(s, F.lit(glyph), F.lit(plain))
    return folded(s, MATH)


def strip_annotations(solution: Column) -> Column:
    return strip(F.regexp_replace(solution, r"<<[^>]*>>", ""))


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE), strip), lambda s: s != "")


def line_key(line: Column) -> Column:
    """What two lines must share to count as a repetition."""
    s = F.regexp_replace(F.lower(strip(line)), f"{WS}+", " ")
    return strip(F.regexp_replace(s, "[^a-z0-9 ]", ""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def cut_at_repeat(text: Column, min_len: int = 12) -> Column:
    """The lines before the first long line that has occurred before."""
    rows = F.split(text, "\n")

    def first_repeat(keys: Column) -> Column:
        return F.array_position(F.transform(keys, lambda k, i: (F.length(k) >= min_len) & (F.array_position(keys, k) < i + 1)), True)

    first = let(F.transform(rows, line_key), first_repeat)
    return F.when(first > 0, F.array_join(F.slice(rows, 1, first.cast("int") - 1), "\n")).otherwise(text)


def truncate_trace(text: Column, min_len: int = 12) -> Column:
    """A trace up to its first answer, the next problem or its first repeated line."""
    s = F.when(F.instr(text, CODE_FENCE) > 0, F.substring_index(text, CODE_FENCE, 1)).otherwise(text)
    for marker in STOP_MARKERS:
        s = F.substring_index(s, marker, 1)
    answered = F.regexp_extract(s, r"(?s)^(.*?####" + WS + r"*\$?-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return F.when(answered != "", strip(answered)).otherwise(strip(cut_at_repeat(s, min_len)))


def six_digits(value: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros, in exponent form if very large or small."""
    magnitude = F.floor(F.log10(F.abs(value)))
    scaled = F.round(value / F.pow(F.lit(10.0), magnitude - 5)) * F.pow(F.lit(10.0), magnitude - 5)
    exponent = F.floor(F.log10(F.abs(scaled)) + 1e-12)
    plain = F.call_function("format_number", scaled, F.lit("0.###########"))
    mantissa = F.call_function("format_number", scaled / F.pow(F.lit(10.0), exponent), F.lit("0.#####"))
    sign = F.when(exponent < 0, "-").otherwise("+")
    return F.when(value == 0, "0").when((exponent < -4) | (exponent >= 6), F.concat(mantissa, F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))).otherwise(plain)


def ensure_hash_line(trace: Column, answer: Column) -> Column:
    """Append the answer in the canonical form unless the trace has one."""
    value = answer.try_cast("double")
    shown = F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(six_digits(value))
    missing = value.isNotNull() & ~trace.rlike(f"#{{3,}}{WS}*-?[0-9]")
    return F.when(missing, F.concat(rstrip(trace), F.lit("\n#### "), shown)).otherwise(trace)


def token_count(text: Column) -> Column:
    """Words between white space, the stand-in for a tokenizer's count."""
    s = strip(F.coalesce(text, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, f"{WS}+")))


def prompt_shots(prompt: Column) -> Column:
    return F.greatest(F.regexp_count(prompt, F.lit("Question:")) - 1, F.lit(0))


def small_fraction(value: Column, tolerance: float = 5e-4) -> Column:
    """The first n/d (n up to 7, then d up to 11) that a number is close to, else ''."""
    options = [F.struct(F.lit(f"{n}/{d}").alias("t"), F.lit(n / d).alias("v")) for n in range(1, 8) for d in range(1, 12)]
    hits = F.filter(F.array(*options), lambda o: F.abs(o["v"] - value) < tolerance)
    return F.coalesce(F.get(hits, 0)["t"], F.lit(""))
