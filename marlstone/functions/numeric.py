"""Numbers, checkpoints, equations and final answers in text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import CHAIN, evaluate_all
from .text import WS, once, strip

# Number tokens, the comma-grouped form first.
GROUPED, PLAIN = r"-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?", r"-?[0-9]+(?:\.[0-9]+)?"
NUM = f"{GROUPED}|{PLAIN}"
PERCENT = f"({NUM}){WS}*%"
FRACTION = rf"(?<![0-9.,])([0-9]+(?:\.[0-9]+)?){WS}*/{WS}*([0-9]+(?:\.[0-9]+)?)(?![0-9.])"
CHECKPOINT = r"<<([^<>=]+)=([^<>]+)>>"
# A left side has no equals sign, so what it takes it never gives back.
EQUATION = rf"[0-9(][0-9.,()%$ \t*/+\-x×÷a-zA-Z']{{0,48}}+{WS}*+={WS}*\$?{WS}*-?[0-9][0-9,]*(?:\.[0-9]+)?"
PURE = r"^[0-9.()*/+\- ]+$"
HASH = rf"#{{3,}}{WS}*(\$?{WS}*{NUM})"
BOXED = rf"\\boxed\{{{WS}*({NUM}){WS}*\}}"
ANSWER_IS = rf"(?i)the answer (?:is|must be){WS}*:?{WS}*(\$?{WS}*{NUM})"


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def to_double(token: Column) -> Column:
    """The number a token spells; null if it spells none."""
    return F.when(token.rlike("^[0-9]+$"), token.try_cast("double")).otherwise(_spelt(token))


def _spelt(token: Column) -> Column:
    bare = strip(F.replace(token, F.lit(","), F.lit("")))
    number = bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$") | bare.rlike(r"(?i)^[+-]?(?:inf|infinity|nan)$")
    return F.when(number, bare.try_cast("double"))


def number(token: Column) -> Column:
    """The number of a token that a number pattern has matched."""
    return F.replace(token, F.lit(","), F.lit("")).try_cast("double")


def doubles(tokens: Column) -> Column:
    return F.transform(tokens, number)


def is_close(a: Column, b: Column, rel: float, abs_: float) -> Column:
    gap = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
    return (gap & (F.abs(a) + F.abs(b) < float("inf"))) | ((a == b) & ~F.isnan(a))


def extract_values(text: Column) -> Column:
    """All values a text expresses: numbers, fractions, percentages in both conventions."""
    none = F.array().cast("array<double>")
    pct = once(doubles(all_of(text, PERCENT, 1)), lambda found: F.concat(found, F.transform(found, lambda v: v / 100)))
    pairs = F.arrays_zip(doubles(all_of(text, FRACTION, 1)).alias("a"), doubles(all_of(text, FRACTION, 2)).alias("b"))
    frac = F.transform(F.filter(pairs, lambda p: p["b"] != 0), lambda p: p["a"] / p["b"])
    shares, ratios = F.when(F.contains(text, F.lit("%")), pct).otherwise(none), F.when(F.contains(text, F.lit("/")), frac).otherwise(none)
    return F.array_distinct(F.concat(shares, ratios, doubles(all_of(text, NUM))))


def value_in(value: Column, pool: Column, tol: float) -> Column:
    same = F.coalesce(F.array_contains(pool, value), F.lit(False)) & ~F.isnan(value)
    # nothing farther away than this is close, and most values are
    bound = F.greatest(F.abs(value), F.lit(1.0)) * (2 * tol)
    return same | once(bound, lambda most: F.exists(pool, lambda v: (F.abs(v - value) <= most) & is_close(v, value, tol, tol)))


def gold_checkpoints(solution: Column) -> Column:
    return F.filter(F.transform(all_of(solution, CHECKPOINT, 2), to_double), lambda v: v.isNotNull())


def checkpoint_result(raw: Column) -> Column:
    """What a whole checkpoint states after its first equals sign."""
    at = F.instr(raw, "=")
    return to_double(F.substr(raw, at + 1, F.length(raw) - at - 2))


def checkpoint_results(solution: Column) -> Column:
    """The same as ``gold_checkpoint_terms`` without all but the results."""
    return F.filter(F.transform(all_of(solution, CHECKPOINT, 0), checkpoint_result), lambda v: v.isNotNull())


def operands(expression: Column) -> Column:
    return F.sort_array(doubles(F.regexp_extract_all(expression, F.lit(NUM), F.lit(0))))


def operators(expression: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.translate(expression, "xX", "**"), F.lit("[-+*/]"), F.lit(0))))


def gold_checkpoint_terms(solution: Column) -> Column:
    """Result, operands, operators and text of each checkpoint."""
    def term(raw: Column) -> Column:
        expression = F.substring_index(raw, "=", 1)  # with its angle brackets, which are no part of numbers and signs
        return F.struct(checkpoint_result(raw).alias("result"), operands(expression).alias("operands"), operators(expression).alias("ops"), raw.alias("raw"))

    return F.filter(F.transform(all_of(solution, CHECKPOINT, 0), term), lambda r: r["result"].isNotNull())


def clean_expression(side: Column) -> Column:
    """The left side of an equation without currency, unit words and percent signs."""
    return F.when(side.rlike(PURE), strip(side)).otherwise(_without_words(side))


def _without_words(side: Column) -> Column:
    s = F.translate(side, "×÷$,", "*/")
    s = F.regexp_replace(s, f"/{WS}*[a-zA-Z]+", "")
    s = F.regexp_replace(s, rf"(?<=[0-9]){WS}*x{WS}*(?=[0-9(])", "*")
    s = F.regexp_replace(s, "[a-zA-Z]+", " ")
    s = F.regexp_replace(s, rf"([0-9]+(?:\.[0-9]+)?){WS}*%", "($1/100)")
    return strip(s)


def evaluable(expression: Column) -> Column:
    """The expression if it is plain, balanced arithmetic with an operator."""
    opened = F.contains(expression, F.lit("(")) | F.contains(expression, F.lit(")"))
    balanced = ~opened | (F.regexp_count(expression, F.lit(r"\(")) == F.regexp_count(expression, F.lit(r"\)")))
    return F.when(expression.rlike(rf"^(?:[0-9.()*/+\-]|{WS})+$") & expression.rlike(r"[*/+\-]") & balanced, expression)


def stated(text: Column) -> Column:
    """The equations of a text as it spells them."""
    return all_of(text, EQUATION)


def left_sides(spelt: Column) -> Column:
    """The left sides of ``stated`` equations as expressions; null where one cannot be valued."""
    def expression(side: Column) -> Column:
        return F.when(side.rlike(CHAIN), side).otherwise(once(clean_expression(side), evaluable))

    return F.transform(spelt, lambda raw: once(F.substring_index(raw, "=", 1), expression))


def sides(spelt: Column, values: Column, tol: float) -> Column:
    """Both sides of the ``stated`` equations that have a value; ``values`` are those of their ``left_sides``."""
    def right(raw: Column) -> Column:
        return number(F.translate(strip(F.substring_index(raw, "=", -1)), "$ \t\r\n", ""))

    rows = F.zip_with(spelt, values, lambda raw, a: F.when(a.isNotNull(), F.struct(a.alias("a"), right(raw).alias("c"), raw.alias("raw"))))
    whole = F.filter(rows, lambda r: r["c"].isNotNull())
    return F.transform(whole, lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"), r["raw"].alias("raw"), is_close(r["a"], r["c"], tol, tol).alias("is_true")))


def equations(both: Column) -> Column:
    """``sides`` with the operands and operators of the left ones."""
    def whole(r: Column) -> Column:
        lhs = F.substring_index(r["raw"], "=", 1)
        return F.struct(r["a"].alias("a"), F.lit("expr").alias("op"), F.lit(0.0).alias("b"), r["c"].alias("c"), strip(r["raw"]).alias("raw"), r["is_true"].alias("is_true"), operands(lhs).alias("operands"), operators(lhs).alias("ops"))

    return F.transform(both, whole)


def extract_equations(text: Column, tol: float = 1e-4) -> Column:
    spelt = stated(text)
    return equations(sides(spelt, evaluate_all(left_sides(spelt)), tol))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def final_answer(trace: Column) -> Column:
    """Marked answer, else boxed, else the last "the answer is", else the last number of the trace.

    The last number lies in the last line that has one, so the two last rungs are one.
    """
    def bare(token: Column) -> Column:
        return to_double(F.replace(token, F.lit("$"), F.lit("")))

    text = F.coalesce(trace, F.lit(""))
    marked, boxed, said = F.regexp_extract(text, HASH, 1), F.regexp_extract(text, BOXED, 1), last(all_of(text, ANSWER_IS, 1))
    return F.when(marked != "", bare(marked)).when(boxed != "", to_double(boxed)).when(said.isNotNull(), bare(said)).otherwise(number(last(all_of(text, NUM))))


def is_correct(answer: Column, gold: Column) -> Column:
    return F.coalesce(answer == gold, F.lit(False))


def final_answer_text(text: Column) -> Column:
    """The answer as generation reads it: a text of digits, without signs; may be empty."""
    token = r"([0-9,]+(?:\.[0-9]+)?)"
    marked = F.regexp_extract(text, f"####{WS}*{token}", 1)
    said = F.regexp_extract(text, rf"(?i)(?:the{WS}+)?answer{WS}*(?:is|=|:){WS}*{token}", 1)
    found = F.when(marked != "", marked).when(said != "", said).otherwise(last(all_of(text, token, 1)))
    return F.replace(found, F.lit(","), F.lit(""))


def gold_answer_value(answer: Column) -> Column:
    return to_double(F.nullif(F.regexp_extract(answer, rf"####{WS}*(-?[0-9,]+(?:\.[0-9]+)?)", 1), F.lit("")))
