"""Value of a plain arithmetic expression: integers exact, decimals as floats.

The grammar is + - * / // ** with the usual precedence, unary signs and parentheses.  Anything else -
two numbers side by side, a call, a stray point, a leading zero, division by zero - has no value, except
0/0, which is not a number.  Powers beyond ``MOST_BITS`` bits have no value either.

``value_of`` is the evaluator as a column: one fold over the tokens of an expression with a stack of open
parentheses, so that it stays in the JVM.  Whole numbers are exact up to 38 digits and floats beyond.  Small whole numbers
need neither the stack nor long numbers and have folds of their own.
``evaluate`` gives the value of one text in Python, with fractions; tests compare the two.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*|\.\d+)|(\d+)|(\*\*|//|[-+*/()]))")
MOST_BITS, DEEPEST = 4096, 64
_LEVEL = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "**": 4}
_SIGN = 3


class _NoValue(Exception):
    pass


def _tokens(text: str) -> list:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _NoValue
        decimal, integer, mark = m.groups()
        if decimal is not None:
            out.append(float(decimal))
        elif integer is not None:
            if integer[0] == "0" and integer.strip("0"):
                raise _NoValue
            out.append(Fraction(int(integer)))
        else:
            out.append(mark)
        at = m.end()
    return out


def _apply(op: str, a, b):
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "**":
        if isinstance(a, Fraction) and isinstance(b, Fraction) and b.denominator == 1:
            if abs(b) * max(a.numerator.bit_length(), a.denominator.bit_length()) > MOST_BITS or a == 0 and b < 0:
                raise _NoValue
            return a ** int(b)
        got = float(a) ** float(b)
        if isinstance(got, complex):
            raise _NoValue
        return got
    if b == 0:
        if a == 0 and op == "/":
            return math.nan
        raise _NoValue
    got = a / b
    return got if op == "/" else Fraction(math.floor(got))


class _Reader:
    def __init__(self, tokens: list):
        self.tokens, self.at = tokens, 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        got = self.peek()
        self.at += 1
        return got

    def value(self, level: int, depth: int):
        if depth > DEEPEST:
            raise _NoValue
        token = self.take()
        if token in ("+", "-") and isinstance(token, str):
            inner = self.value(_SIGN, depth + 1)
            left = -inner if token == "-" else inner
        elif token == "(" and isinstance(token, str):
            left = self.value(0, depth + 1)
            if self.take() != ")":
                raise _NoValue
        elif isinstance(token, (float, Fraction)):
            left = token
        else:
            raise _NoValue
        while isinstance(op := self.peek(), str) and op in _LEVEL and _LEVEL[op] > level - (op == "**"):
            self.take()
            left = _apply(op, left, self.value(_LEVEL[op] - (op == "**"), depth + 1))
        return left


def evaluate(text: str) -> float | None:
    try:
        reader = _Reader(_tokens(text))
        got = reader.value(0, 0)
        if reader.peek() is not None:
            return None
        return float(got)
    except (_NoValue, OverflowError, ZeroDivisionError, ValueError):
        return None


# ------------------------------------------------------------ as columns
# A number is a whole one and its float; the whole one is null if it has a fraction or over 38 digits, both are null if there is no value.
_NUMBER = "struct<n:decimal(38,0),x:double>"
# What is open in a parenthesis: the sum so far and the sign of what is added next, the product so far and what
# comes between it and the next factor, and the signed numbers of that factor, each the power of the one before.
_FRAME = f"struct<total:{_NUMBER},minus:boolean,product:{_NUMBER},by:string,tower:array<struct<negative:boolean,value:{_NUMBER}>>,negative:boolean>"
_STATE = f"struct<stack:array<{_FRAME}>,wants:boolean,fine:boolean>"
TOKEN = r"[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+|\*\*|//|[-+*/()]"


def _number(n: Column, x: Column) -> Column:
    """``x`` counts where there is no whole number."""
    return once(n.cast("decimal(38,0)"), lambda whole: F.struct(whole.alias("n"), F.coalesce(whole.cast("double"), x).alias("x")))


def _read(token: Column) -> Column:
    whole = F.when(token.rlike("^(?:0+|[1-9][0-9]*)$"), token.try_cast("decimal(38,0)"))
    return _number(whole, F.when(~token.rlike("^0+[1-9][0-9]*$"), token.try_cast("double")))


def _negated(v: Column) -> Column:
    return _number(-v["n"], -v["x"])


def _sum(a: Column, minus: Column, b: Column) -> Column:
    """``a`` with ``b`` added or taken away; ``b`` signed if there is no ``a``."""

    def with_sign(b: Column) -> Column:
        return F.when(a.isNull(), b).otherwise(_number(F.try_add(a["n"], b["n"]), a["x"] + b["x"]))

    return once(F.when(minus, _negated(b)).otherwise(b), with_sign)


def _quotient(a: Column, b: Column) -> Column:
    whole = F.when((b["n"] != 0) & (F.try_mod(a["n"], b["n"]) == 0), F.try_divide(a["n"], b["n"]).cast("decimal(38,0)"))
    x = F.when((b["x"] == 0) & (a["x"] == 0), F.lit(math.nan)).when(b["x"] != 0, a["x"] / b["x"])
    return _number(whole, x)


def _floored(a: Column, b: Column) -> Column:
    rest = F.pmod(a["n"], b["n"])
    down = F.when((rest > 0) & (b["n"] < 0), rest + b["n"]).otherwise(rest)  # has the sign of b
    part = F.try_divide(a["x"], b["x"])
    whole = F.when(a["n"].isNotNull() & b["n"].isNotNull(), F.try_divide(a["n"] - down, b["n"])).when(~F.isnan(part), F.floor(part).cast("decimal(38,0)"))
    return _number(F.when(b["x"] != 0, whole), F.lit(None).cast("double"))


def _power(a: Column, b: Column) -> Column:
    size = F.when(a["n"] == 0, 1).otherwise(F.floor(F.log2(F.abs(a["x"]))) + 1)
    bits = F.when(a["n"].isNotNull() & b["n"].isNotNull(), F.abs(b["x"]) * size)

    def bounded(x: Column) -> Column:
        good = ~F.isnan(x) & (F.abs(x) != float("inf")) & (F.coalesce(bits, F.lit(0)) <= MOST_BITS)
        whole = F.when(a["n"].isNotNull() & b["n"].isNotNull() & (b["n"] >= 0) & (F.abs(x) < 2.0**53), F.round(x, 0).cast("decimal(38,0)"))
        return F.struct(F.when(good, whole).alias("n"), F.when(good, x).alias("x"))

    return once(F.pow(a["x"], b["x"]), bounded)


def _factor(tower: Column) -> Column:
    """The value of a factor: powers from the right, a sign after its number's power."""
    def onto(above: Column, t: Column) -> Column:
        raised = F.when(above.isNull(), t["value"]).otherwise(_power(t["value"], above))
        return once(raised, lambda v: F.when(t["negative"], _negated(v)).otherwise(v))

    many = F.aggregate(F.reverse(tower), F.lit(None).cast(_NUMBER), onto)
    only = F.get(tower, 0)
    return F.when(F.size(tower) == 1, F.when(only["negative"], _negated(only["value"])).otherwise(only["value"])).otherwise(many)


def _product(f: Column) -> Column:
    """The product so far with the open factor."""

    def times(b: Column) -> Column:
        a, by = f["product"], f["by"]
        return F.when(a.isNull(), b).when(by == "*", _number(F.try_multiply(a["n"], b["n"]), a["x"] * b["x"])).when(by == "/", _quotient(a, b)).otherwise(_floored(a, b))

    return once(_factor(f["tower"]), times)


def _closed(f: Column) -> Column:
    """The value of a parenthesis."""
    return once(_product(f), lambda p: _sum(f["total"], f["minus"], p))


def _frame(total=None, minus=None, product=None, by=None, tower=None, negative=None) -> Column:
    none, no = F.lit(None).cast(_NUMBER), F.lit(False)
    empty = F.array().cast(f"array<struct<negative:boolean,value:{_NUMBER}>>")
    given = (none if total is None else total, no if minus is None else minus, none if product is None else product, F.lit(None).cast("string") if by is None else by, empty if tower is None else tower, no if negative is None else negative)
    return F.struct(*[c.alias(n) for c, n in zip(given, ("total", "minus", "product", "by", "tower", "negative"))]).cast(_FRAME)


def _step(s: Column, token: Column) -> Column:
    stack, wants = s["stack"], s["wants"]
    depth = F.size(stack)
    top, below = F.element_at(stack, -1), F.slice(stack, 1, depth - 1)

    def state(frames: Column, wants: bool) -> Column:
        return F.struct(frames.alias("stack"), F.lit(wants).alias("wants"), F.lit(True).alias("fine")).cast(_STATE)

    def replaced(frame: Column, wants: bool, under: Column = below) -> Column:
        return state(F.concat(under, F.array(frame)), wants)

    def of(f: Column) -> Column:
        return once(F.when(~wants & (token != "**"), _product(f)), lambda product: once(F.when(token.isin("+", "-", ")"), _sum(f["total"], f["minus"], product)), lambda closed: next_state(f, product, closed)))

    def next_state(f: Column, product: Column, closed: Column) -> Column:
        number = wants & token.rlike("^[.0-9]")
        ends = ~wants & (token == ")") & (depth > 1)
        outer, under = F.when(ends, F.element_at(stack, -2)).otherwise(f), F.slice(stack, 1, F.when(ends, depth - 2).otherwise(depth - 1))
        entry = F.array(F.struct(outer["negative"].alias("negative"), F.when(ends, closed).otherwise(_read(token)).alias("value")))
        with_value = _frame(outer["total"], outer["minus"], outer["product"], outer["by"], F.concat(outer["tower"], entry))
        signed = _frame(f["total"], f["minus"], f["product"], f["by"], f["tower"], f["negative"] != (token == "-"))
        summed, multiplied = _frame(closed, token == "-"), _frame(f["total"], f["minus"], product, token)
        sign, operator = token.isin("+", "-"), ~wants & token.isin("*", "/", "//", "+", "-")
        return (
            F.when(~s["fine"], s)
            .when(number | ends, replaced(with_value, False, under))
            .when(wants & (token == "("), state(F.concat(stack, F.array(_frame())), True))
            .when(wants & sign, replaced(signed, True))
            .when(~wants & (token == "**"), state(stack, True))
            .when(operator, replaced(F.when(sign, summed).otherwise(multiplied), True))
            .otherwise(F.struct(stack.alias("stack"), wants.alias("wants"), F.lit(False).alias("fine")).cast(_STATE))
        )

    return once(top, of)


_WHOLE = "(?:0|[1-9][0-9]{0,8})"
#: Short whole numbers with one sign between two of them.
CHAIN = rf"^ *{_WHOLE}(?: *[-+*] *{_WHOLE})+ *$"
# Short whole numbers and their powers of one digit in a row, where a bracket without brackets inside may stand for a number.
_SIGN_BETWEEN, _RAISED = "(?://|[-+*/])", rf"{_WHOLE}(?:\*\*[0-9])?"
_BRACKET = rf"\( *{_RAISED} *(?:{_SIGN_BETWEEN} *{_RAISED} *)*\)"
SHALLOW = rf"^ *(?:{_RAISED}|{_BRACKET}) *(?:{_SIGN_BETWEEN} *(?:{_RAISED}|{_BRACKET}) *)*$"


def value_of(expression: Column) -> Column:
    """The value of an expression; null if it has none.

    Plain sums and products of two of short whole numbers, which is what most traces state, need no stack, nor do
    small whole numbers with brackets one deep.
    """
    bare = F.translate(expression, " ", "")
    summed = F.aggregate(F.regexp_extract_all(bare, F.lit("[-+]?[0-9]+"), F.lit(0)), F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
    product = F.substring_index(bare, "*", 1).cast("long") * F.substring_index(bare, "*", -1).cast("long")
    whole = F.when(expression.rlike(rf"^ *{_WHOLE} *\* *{_WHOLE} *$"), product).when(expression.rlike(rf"^ *{_WHOLE}(?: *[-+] *{_WHOLE})* *$"), summed).cast("double")
    shallow = F.when(expression.rlike(SHALLOW), once(F.replace(bare, F.lit("**"), F.lit("^")), _shallow))
    return F.when(expression.isNotNull(), F.coalesce(whole, shallow, _value_of(expression)))


def _shallow(bare: Column) -> Column:
    """The value of a ``SHALLOW`` expression, ``^`` for powers, where floats are sure to have it; else null.

    Floats are exact for whole numbers of this size, so each sign gives what the stack gives.  Zero and what divides by zero are left to the stack.
    """

    def single(token: Column) -> Column:
        raised = F.round(F.pow(F.substring_index(token, "^", 1).cast("double"), F.substring_index(token, "^", -1).cast("double")), 0)
        return F.when(F.contains(token, F.lit("^")), raised).otherwise(token.try_cast("double"))

    def in_bracket(token: Column) -> Column:
        return _row_of(F.transform(F.regexp_extract_all(token, F.lit("[0-9^]+"), F.lit(0)), single), F.regexp_extract_all(token, F.lit(_SIGN_BETWEEN), F.lit(0)))

    opened = F.contains(bare, F.lit("("))
    factors = F.regexp_extract_all(bare, F.lit(r"\([^()]*\)|[0-9^]+"), F.lit(0))
    outside = F.when(opened, F.regexp_replace(bare, r"\([^()]*\)", "0")).otherwise(bare)
    values = F.transform(factors, lambda t: F.when(F.startswith(t, F.lit("(")), in_bracket(t)).otherwise(single(t)))
    return _row_of(values, F.regexp_extract_all(outside, F.lit(_SIGN_BETWEEN), F.lit(0)))


def _row_of(values: Column, signs: Column) -> Column:
    """The value of numbers with signs between them; null if it is zero, divides by zero or is not sure to be exact."""

    def step(s: Column, x: Column) -> Column:
        sign, v, p = x["sign"], x["v"], s["product"]
        added = sign.isin("+", "-")
        parts = {
            "total": F.when(added, s["total"] + F.when(s["minus"], -p).otherwise(p)).otherwise(s["total"]),
            "product": F.when(added, v).when(sign == "*", p * v).when(v != 0, F.when(sign == "/", p / v).otherwise(F.floor(p / v).cast("double"))),
            "minus": F.when(added, sign == "-").otherwise(s["minus"]),
        }
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    def of(values: Column) -> Column:
        pairs = F.zip_with(F.concat(F.array(F.lit("+")), signs), values, lambda sign, v: F.struct(sign.alias("sign"), v.alias("v")))
        none = F.lit(0.0), F.lit(0.0), F.lit(False)
        start = F.struct(*[c.alias(n) for c, n in zip(none, ("total", "product", "minus"))]).cast("struct<total:double,product:double,minus:boolean>")
        small = F.aggregate(values, F.lit(1.0), lambda acc, v: acc * (F.abs(v) + 1)) < 2.0**31
        return F.when(small, F.nullif(F.aggregate(pairs, start, step, lambda s: s["total"] + F.when(s["minus"], -s["product"]).otherwise(s["product"])), F.lit(0.0)))

    return once(values, of)


def _value_of(expression: Column) -> Column:
    strange = F.regexp_replace(expression, rf"{TOKEN}|\s", "") != ""
    tokens = F.regexp_extract_all(expression, F.lit(TOKEN), F.lit(0))
    start = F.struct(F.array(_frame()).alias("stack"), F.lit(True).alias("wants"), F.lit(True).alias("fine")).cast(_STATE)

    def result(s: Column) -> Column:
        return F.when(s["fine"] & ~s["wants"] & (F.size(s["stack"]) == 1), _closed(F.get(s["stack"], 0))["x"])

    return F.when(expression.isNotNull() & ~strange, F.get(F.transform(F.array(F.aggregate(tokens, start, _step)), result), 0))


def evaluate_all(expressions) -> Column:
    """Values of the expressions of an array; null where there is none."""
    return F.transform(expressions, value_of)
