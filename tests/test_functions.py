import itertools
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions import numeric as N
from marlstone.functions import question as Q
from marlstone.functions import rules as L
from marlstone.functions import statistics as P
from marlstone.functions import steps as E
from marlstone.functions import text as T
from marlstone.functions.arith import evaluate, value_of
from marlstone.operators import extract, redundancy
from marlstone.operators.score import score
from marlstone.params import DEFAULTS, Params


def of(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2½ cups", "21/2 cups"), ("a b c", "a b c"), ("“x” ‘y’", "\"x\" 'y'"), ("3 × 4 ÷ 2 − 1 ＝ 5", "3 * 4 / 2 - 1 = 5"), ("a  \t b\n\n\n\nc", "a b\n\nc"), ("  x \x1c", "x"), ("", ""),
    ],
)
def test_normalize(spark, text, want):
    assert of(spark, text, T.normalize_math) == want


def test_vulgar_spacing_keeps_the_number_apart(spark):
    assert of(spark, "2½ cups", lambda c: T.normalize_math(c, vulgar_spacing=True)) == "2 1/2 cups"


@pytest.mark.parametrize(
    "text, want",
    [
        ("75%", {75.0, 0.75}), ("3/4. ok", {3.0, 4.0}), ("3/4 ok", {0.75, 3.0, 4.0}), ("1,234.5", {1234.5}), ("48-24", {48.0, -24.0}), ("48 - 24", {48.0, 24.0}), ("no digits", set()), ("1/0", {1.0, 0.0}), ("1,2345", {1234.0, 5.0}),
    ],
)
def test_values(spark, text, want):
    assert set(of(spark, text, N.extract_values)) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("48-24 = 24", [(24.0, 24.0, True, [-24.0, 48.0], ["-"])]), ("3 boxes * 4 = 12", [(12.0, 12.0, True, [3.0, 4.0], ["*"])]), ("12 x 50/60 = 10", [(10.0, 10.0, True, [12.0, 50.0, 60.0], ["*", "/"])]),
        ("$12/hour * 2 hour = $24", [(24.0, 24.0, True, [2.0, 12.0], ["*", "/"])]), ("5 apples. He has 3 + 4 = 7", []), ("(1+2 = 3", []), ("answer = 35", []), ("1/0 = 0", []),
        ("10*(80%) = 8", [(8.0, 8.0, True, [10.0, 80.0], ["*"])]), ("2 + 2 = 5", [(4.0, 5.0, False, [2.0, 2.0], ["+"])]), ("50 minutes / 60 = 0.8333", [(50 / 60, 0.8333, True, [50.0, 60.0], ["/"])]), ("", []),
    ],
)
def test_equations(spark, text, want):
    got = of(spark, text, N.extract_equations)
    assert [(pytest.approx(e.a), e.c, e.is_true, e.operands, e.ops) for e in got] == want and all(e.op == "expr" and e.b == 0 for e in got)


@pytest.mark.parametrize(
    "text, want",
    [
        ("#### $72", 72.0), ("#### $1,200", 1200.0), ("### 5\n#### 6", 5.0), (r"so \boxed{ 7 } and 8", 7.0), ("The answer is 3. The answer must be: 4. Then 9", 4.0), ("The answer is -5", -5.0),
        ("x 7 y\nno number\nend", 7.0), ("", None), ("none", None), ("#### -3", -3.0),
    ],
)
def test_final_answer(spark, text, want):
    assert of(spark, text, N.final_answer) == want


def test_generation_reads_no_signs(spark):
    assert of(spark, "The answer is -5", N.final_answer_text) == "5"
    assert of(spark, "#### 1,200.5 x", N.final_answer_text) == "1200.5"


@pytest.mark.parametrize(
    "text, want",
    [
        ("1+2*3", 7), ("(1+2)*3", 9), ("-2**2", -4), ("2**3**2", 512), ("2**-1", 0.5), ("7//2", 3), ("1/3*3", 1), ("0.1+0.2", 0.1 + 0.2), ("5.", 5), (".5*2", 1), ("- -3", 3), ("2*-3", -6), ("1e3", None), ("3 4", None), ("2(3)", None),
        ("1/0", None), ("007+1", None), ("00", 0), ("1.2.3", None), ("", None), ("(", None), ("()", None), ("9**9**9", None), ("3//0", None), ("1 - 2 - 3", -4), ("8/4/2", 1),
    ],
)
def test_arithmetic(text, want):
    got = evaluate(text)
    assert got == want if want is None or got is None else math.isclose(got, want)


def test_zero_by_zero_is_not_a_number():
    assert math.isnan(evaluate("0/0"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("a\nQuestion: b", "a"), ("x\n#### 5 and more", "x\n#### 5"), ("first long line here\nshort\nFirst LONG line, here!\nend", "first long line here\nshort"), ("ok\\begin{code} z", "ok"), ("same\nsame\nsame", "same\nsame\nsame"),
    ],
)
def test_truncate(spark, text, want):
    assert of(spark, text, T.truncate_trace) == want


@pytest.mark.parametrize("answer, want", [(12.0, "12"), (12.5, "12.5"), (1 / 3, "0.333333"), (1234567.8, "1.23457e+06"), (0.00001234, "1.234e-05"), (-2.5, "-2.5")])
def test_hash_line(spark, answer, want):
    assert of(spark, "so it is \n", lambda c: T.ensure_hash_line(c, F.lit(answer))) == f"so it is\n#### {want}"


def test_hash_line_is_kept(spark):
    assert of(spark, "x\n### 4", lambda c: T.ensure_hash_line(c, F.lit(9.0))) == "x\n### 4"


@pytest.mark.parametrize("text, want", [("One. Two! Three?", ["One.", "Two!", "Three?"]), ("a\n\n b \n#### 5", ["a", "b"]), ("", []), ("a\x1cb c", ["a", "b", "c"]), ("No stop here", ["No stop here"])])
def test_steps(spark, text, want):
    assert of(spark, text, E.split_steps) == want


def test_redundancy_variants():
    steps = ["add two and three", "add two and three", "something else entirely"]
    assert E.redundancy_of(steps, "dup_fraction", 0.9) == 0.5
    assert E.redundancy_of(steps, "max", 0.9) == pytest.approx(0)
    assert E.redundancy_of(steps, "mean_pairwise", 0.9) == pytest.approx(2 / 3)
    assert E.redundancy_of(["1 2"], "max", 0.9) == 1.0 and E.redundancy_of(["1", "2"], "dup_fraction", 0.9) == 1.0
    with pytest.raises(ValueError):
        E.redundancy(F.lit(1), "none")


DIAGNOSES = [
    (0.10, 0, 3, 3, 1, None, 0, "NR", 0.6667), (0.25, 1, 1, 4, 1, True, 1, "ST", 0.5833), (1 / 3, 1, 3, 3, 1, True, 2, "UNCLASSIFIED", 0), (0.25, 1, 4, 4, 1, True, 2, "UNCLASSIFIED", 0), (0.0, 1, 3, 3, 0.8, True, 3, "SM", 0.4286),
    (0.0, 1, 3, 3, 0.8, None, 3, "UNCLASSIFIED", 0), (0.75, 0.5, 4, 4, 1, False, 2, "CE", 0.4118), (0.75, 0.0, 4, 4, 1, False, 2, "CE", 0.4286), (0.75, 1.0, 4, 4, 1, True, 4, "UNCLASSIFIED", 0), (0.75, 0.5, 3, 5, 1, True, 2, "UNCLASSIFIED", 0),
]


def test_diagnose(spark):
    rows = spark.createDataFrame([(i, float(e), float(v), s, h, float(g), c, n) for i, (e, v, s, h, g, c, n, *_) in enumerate(DIAGNOSES)], "i int, e double, v double, s int, h int, g double, c boolean, n int")
    got = {r.i: r.d for r in rows.select("i", L.diagnose(*(F.col(x) for x in "evshgcn")).alias("d")).collect()}
    for i, (*_, kind, confidence) in enumerate(DIAGNOSES):
        assert got[i].ftype == kind and got[i].confidence == pytest.approx(confidence, abs=1e-4)
    strict = Params(diag_min_confidence=0.5)
    weak = {r.i: r.d for r in rows.select("i", L.diagnose(*(F.col(x) for x in "evshgcn"), strict).alias("d")).collect()}
    assert weak[4].ftype == "UNCLASSIFIED" and weak[4].reason.startswith("abstain: SM fired") and weak[0].ftype == "NR"


def test_classify(spark):
    cases = [(True, 0, 0, True, 0.6, 0.0, "GOOD"), (True, 0, 0, None, 1.0, 0.0, "MEDIUM_CORRECT"), (True, 0, 0, True, 0.59, 0.0, "MEDIUM_CORRECT"), (True, 5, 3, False, 0.0, 0.0, "MEDIUM_CORRECT"), (False, 1, 1, True, 0.0, 0.5, "MEDIUM_WRONG"), (False, 2, 0, True, 1.0, 1.0, "BAD_WRONG"), (False, 0, 0, None, 1.0, 1.0, "BAD_WRONG")]
    rows = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, a boolean, b int, c int, d boolean, e double, f double")
    got = {r.i: r.l for r in rows.select("i", L.classify(*(F.col(x) for x in "abcdef")).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[6] for c in cases]


def test_close_values_guard_infinities(spark):
    inf, nan = float("inf"), float("nan")
    for a, b, want in ((1.0, 1.0000001, True), (inf, 5.0, False), (inf, inf, True), (nan, nan, False), (0.0, 1e-7, True)):
        assert value(spark, N.is_close(F.lit(a), F.lit(b), 1e-6, 1e-6)) is want


def test_statistics(spark):
    lo, hi = P.wilson(F.lit(13), F.lit(142))
    assert value(spark, lo) == pytest.approx(0.0542825, abs=1e-7) and value(spark, hi) == pytest.approx(0.1503340, abs=1e-7)
    gap = [value(spark, c) for c in P.newcombe(F.lit(13), F.lit(142), F.lit(60), F.lit(1076))]
    assert gap == pytest.approx([0.0357872, -0.0045200, 0.0958240], abs=1e-7)
    assert value(spark, P.fisher_p(*(F.lit(x).cast("long") for x in (13, 129, 60, 1016)))) == pytest.approx(0.0927015, abs=1e-7)
    assert value(spark, P.binomial_p(F.lit(9), F.lit(308))) == pytest.approx(2.415076e-76, rel=1e-5)
    assert value(spark, P.chi2_sf(F.lit(0.4554582), F.lit(1))) == pytest.approx(0.4997543, abs=1e-6)
    assert value(spark, P.chi2_sf(F.lit(271.1720779), F.lit(1))) == pytest.approx(math.erfc(math.sqrt(271.1720779 / 2)), rel=1e-6)
    assert value(spark, P.chi2_sf(F.lit(8.433185), F.lit(12))) == pytest.approx(0.750429, abs=1e-6)
    assert value(spark, P.wilson(F.lit(0), F.lit(0))[0]) == 0.0 and value(spark, P.binomial_p(F.lit(0), F.lit(0))) == 1.0


def test_questions(spark):
    q = "A shop sells 3 pens at $2 each. How many dollars in total for 12 pens?"
    got = of(spark, q, Q.categorize)
    assert (got.category_type, got.complexity, got.estimated_steps) == ("monetary", "simple", 1) and "$" in got.keyword_hits
    assert of(spark, "multiply them", lambda c: Q.category_type(c)) == "percentage"
    assert of(spark, "multiply them", lambda c: Q.category_type(c, word_boundaries=True)) == "arithmetic"
    assert of(spark, "2 + 3 and 4 + 1 then 9 * 2", lambda c: Q.main_operation(c)) == "addition"
    assert of(spark, "2 + 3 * 4", lambda c: Q.main_operation(c)) == "mixed" and of(spark, "hi", lambda c: Q.main_operation(c)) == "none"
    assert of(spark, "short", Q.richness) == pytest.approx(0.105)


def test_snapshot_has_scalars_only():
    assert DEFAULTS.snapshot()["g_min"] == 0.5 and "z" in DEFAULTS.snapshot()


# ------------------------------------------------------------ expressions and redundancy as columns
EDGES = ["1+2", "12 * 50/60", "2**3**2", "-2**2", "2**-1", "-(2)**2", "2*-3**2", "7//2", "-7//2", "7//-2", "-321//(-210)//-15", "7.5//2", "0/0", "1/0", "0//0", "0*7.16/0//458", "012", "00", "1.2.3", "5 .", "2 3", "2(3)"]
EDGES += ["((1+2)*3)", "(1+2", "1+2)", "()", "+", "--3", "2**0.5", "(-8)**(1/3)", "0**-1", "10/4*2", "99999999999999999999*99999999999999999999", "2**5000", "1e5", "3 boxes", "5-3-2", "8/2/2", "48-24", "12 * 50/60", "(1/100)*50", ".5+.5", "5.", "6/(3-3)", ""]


def test_native_values_are_those_of_fractions(spark):
    rng = random.Random(1)

    def made(depth):
        if not depth or rng.random() < 0.3:
            return str(rng.choice([rng.randrange(20), rng.randrange(1000), round(rng.random() * 10, 2)]))
        kind = rng.randrange(8)
        return f"({made(depth - 1)})" if kind == 6 else f"-{made(depth - 1)}" if kind == 7 else made(depth - 1) + rng.choice([" + ", "-", "*", "/", "//"]) + made(depth - 1)

    parts = ["1", "2", "12", "0.5", "7", "0", "+", "-", "*", "/", "**", "//", "(", ")", " "]
    texts = EDGES + [made(4) for _ in range(300)] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", value_of(F.col("t")).alias("v")).collect()
    for r in got:
        want = evaluate(r.t)
        if want is None or math.isnan(want):
            assert r.v is None if want is None else math.isnan(r.v), r.t
        else:
            assert r.v == pytest.approx(want, rel=1e-12), r.t
    assert spark.range(1).select(value_of(F.lit(None).cast("string")).alias("v")).first().v is None


def test_native_redundancy_and_its_joins(spark):
    rng = random.Random(2)
    words = "12 24 36 total cost the box of pins is x 7 Ünï_code été ten".split()
    rows = [[], ["a b"], ["1", "2"], ["12 34", "12 34"], ["12 34", "34 12"], ["", ""], ["!!", "12"], ["12", "12", "12", "!!"]]
    rows += [[" ".join(rng.choice(words) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(9))] for _ in range(150)]
    rows.append([f"line {i % 40} of {i % 7} items" for i in range(400)])
    df = spark.createDataFrame(list(enumerate(rows)), "id int, steps array<string>")
    joined = {r.id: r for r in redundancy.redundancy(df, ["id"], "steps").collect()}
    in_row = {r.id: r for r in df.where("size(steps) < 100").select("id", *[E.redundancy(F.col("steps"), v).alias(v) for v in E.VARIANTS]).collect()}
    for i, steps in enumerate(rows):
        for v in E.VARIANTS:
            want = E.redundancy_of(steps, v, 0.9)
            assert joined[i][v] == pytest.approx(want, abs=1e-9), (steps[:5], v)
            assert i not in in_row or in_row[i][v] == pytest.approx(want, abs=1e-9)


def test_pairs_of_steps_above_a_threshold(spark):
    rng = random.Random(3)
    rows = [(i, [" ".join(rng.choice("alpha beta gamma delta eps".split()) for _ in range(rng.randrange(1, 6))) for _ in range(12)]) for i in range(30)]
    weights = redundancy.unit_weights(redundancy.step_kinds(spark.createDataFrame(rows, "id int, steps array<string>"), ["id"], "steps"), ["id"])
    every = {(r.id, r.i, r.j): r.cos for r in redundancy.pairs_sharing(weights, ["id"]).collect()}
    for threshold in (0.5, 0.9):
        got = {(r.id, r.i, r.j): r.cos for r in redundancy.step_pairs(weights, ["id"], threshold).collect()}
        assert got == pytest.approx({k: v for k, v in every.items() if v > threshold})


def test_band_join_finds_what_is_close(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1e-9, -1e-9, 1.0, -1.0, 0.999999, 1.000001, 1e12, float("inf"), float("-inf"), float("nan"), None] + [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 6) for _ in range(150)]
    for tol in (1e-6, 0.01, 0.3):
        near = [v * (1 + rng.uniform(-2, 2) * tol) + rng.uniform(-2, 2) * tol if v is not None and abs(v) < 1e300 else v for v in values]
        a, b = (spark.createDataFrame([("k", v) for v in x], "key string, value double") for x in (values, near))
        got = sorted((r.wanted, r.near) for r in extract.matched_values(a, b, tol, "key").collect())
        assert got == sorted((x, y) for x in near for y in values if x is not None and y is not None and math.isclose(x, y, rel_tol=tol, abs_tol=tol))


def test_redundancy_of_nearly_equal_steps(spark):
    """What the quick bound rules out has no pair above the threshold; labels need no operators of equations."""
    steps = ["12 * 30 = 360", "12 * 30 = 361", "12 + 30 = 42 apples", "360 + 42 = 402", "we add 360 and 42", "we add 360 and 43", "so so so", "so so", "é 12 30 360", "?"]
    lists = [list(c) for n in (2, 3, 4) for c in itertools.combinations(steps, n)] + [steps, steps * 2]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(lists)], "i int, steps array<string>").select("i", E.redundancy(F.col("steps")).alias("r")).collect()
    assert all(r.r == pytest.approx(E.redundancy_of(lists[r.i], "dup_fraction", 0.9)) for r in got)
    rows = spark.createDataFrame([("a", "2 * 3 = 6\n#### 6", "<<2*3=6>>6\n#### 6", 6.0)], "question string, trace string, gold_solution string, gold_answer double")
    assert "[-+*/]," not in score(rows).select("label")._jdf.queryExecution().optimizedPlan().toString()


def test_fisher_of_large_counts(spark):
    """A million rows: before, every table with the margins was added to a list that was copied each time."""
    at = time.time()
    got = value(spark, P.fisher_p(*(F.lit(x).cast("long") for x in (150_300, 149_700, 349_700, 350_300))))
    assert got == pytest.approx(0.191170, abs=1e-6) and time.time() - at < 60
    assert value(spark, P.fisher_p(*(F.lit(x).cast("long") for x in (300, 300, 300, 300)))) == pytest.approx(1.0)
