"""Signals, label and diagnosis of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as L
from ..functions.arith import evaluate_all
from ..functions.steps import redundancy, split_steps
from ..functions.text import built, normalize_math, once
from ..params import DEFAULTS, Params

SIGNALS = ("E", "V", "R", "A", "G", "coherent", "correct", "final_answer", "misses", "bad_eqs", "n_steps", "n_checkpoints", "n_equations", "r_variant", "E_struct", "A_struct")
RESTS_ON = ("E", "V", "coherent", "correct", "final_answer", "n_steps", "n_checkpoints", "n_equations")
#: All that scoring adds to an attempt.
FOUND = (*SIGNALS, "trace_scored", "label", "diagnosis", "diagnosis_reason", "diagnosis_confidence")
PARSED = ("trace_scored", "gold_scored", "values__", "question_values__", "checkpoints__", "terms__", "stated__", "lhs__", "sides__", "eqs__", "steps__")


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(float(empty)))


def how_many(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def parsed(attempts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """What the signals are computed from, each text read once."""

    def texts() -> dict[str, Column]:
        trace, gold = F.coalesce("trace", F.lit("")), F.coalesce("gold_solution", F.lit(""))
        if p.normalize_traces:
            trace, gold = normalize_math(trace, p.vulgar_spacing), normalize_math(gold, p.vulgar_spacing)
        return {"trace_scored": trace, "gold_scored": gold}

    def parts() -> dict[str, Column]:
        return {
            "values__": N.extract_values(F.col("trace_scored")),
            "question_values__": N.extract_values(F.coalesce("question", F.lit(""))),
            "checkpoints__": N.checkpoint_results(F.col("gold_scored")),
            "terms__": N.gold_checkpoint_terms(F.col("gold_scored")),
            "stated__": N.stated(F.col("trace_scored")),
            "steps__": split_steps(F.col("trace_scored"), p.step_split_sentences),
        }

    def computed() -> dict[str, Column]:
        return {"lhs__": evaluate_all(N.left_sides(F.col("stated__"))), "R": redundancy(F.col("steps__"), p.r_variant, p.dup_sim_threshold)}

    def valued() -> dict[str, Column]:
        return {"sides__": N.sides(F.col("stated__"), F.col("lhs__"), p.equation_tol)}

    def whole() -> dict[str, Column]:
        return {"eqs__": N.equations(F.col("sides__"))}

    for make in (texts, parts, computed, valued, whole):
        attempts = attempts.withColumns(built((make.__name__, p), make))
    return attempts


def signals(attempts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``attempts`` (question, trace, gold_solution, gold_answer) with all signals and what they rest on."""
    tol = p.value_match_tol

    def first() -> dict[str, Column]:
        eqs, values, checkpoints, terms = F.col("sides__"), F.col("values__"), F.col("checkpoints__"), F.col("terms__")
        n, n_eq = F.size(checkpoints), F.size(eqs)
        right, true_eqs = how_many(eqs, lambda e: e["is_true"]), F.filter("eqs__", lambda e: e["is_true"])

        def by_operands(g: Column, e: Column) -> Column:
            return N.is_close(e["c"], g["result"], tol, tol) & (e["operands"] == g["operands"])

        return {
            "hits__": how_many(checkpoints, lambda c: N.value_in(c, values, tol)),
            "final_answer": N.final_answer(F.col("trace_scored")),
            "n_steps": F.size("steps__"),
            "n_checkpoints": n,
            "n_equations": n_eq,
            "V": share(right, n_eq, 0),
            "bad_eqs": n_eq - right,
            "A": share(how_many(checkpoints, lambda c: F.exists(eqs, lambda e: N.is_close(e["c"], c, tol, tol))), n, 0),
            "G": share(how_many(F.col("question_values__"), lambda v: N.value_in(v, values, tol)), F.size("question_values__"), 1),
            "E_struct": share(how_many(terms, lambda g: F.exists(true_eqs, lambda e: by_operands(g, e))), n, 0),
            "A_struct": share(how_many(terms, lambda g: F.exists(true_eqs, lambda e: by_operands(g, e) & (F.size(F.array_except(g["ops"], e["ops"])) == 0))), n, 0),
            "r_variant": F.lit(p.r_variant),
        }

    def second() -> dict[str, Column]:
        eqs = F.col("sides__")
        coherent = F.when((F.size(eqs) > 0) & F.col("final_answer").isNotNull(), N.is_close(N.last(eqs)["c"], F.col("final_answer"), tol, tol))
        return {"E": share(F.col("hits__"), F.col("n_checkpoints"), 0), "misses": F.col("n_checkpoints") - F.col("hits__"), "coherent": coherent, "correct": N.is_correct(F.col("final_answer"), F.col("gold_answer"))}

    rows = parsed(attempts, p)
    for make in (first, second):
        rows = rows.withColumns(built((make.__name__, p), make))
    return rows


def with_diagnosis(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:

    def label() -> dict[str, Column]:
        return {"label": L.classify(*(F.col(c) for c in ("correct", "misses", "bad_eqs", "coherent", "R", "G")), p)}

    def found() -> dict[str, Column]:
        return {"found__": F.when(L.needs_diagnosis(F.col("label")), L.diagnose(*(F.col(c) for c in ("E", "V", "n_steps", "n_checkpoints", "G", "coherent", "n_equations")), p))}

    for make in (label, found):
        rows = rows.withColumns(built((make.__name__, p), make))
    return rows.withColumns({"diagnosis": F.col("found__.ftype"), "diagnosis_reason": F.col("found__.reason"), "diagnosis_confidence": F.col("found__.confidence")})


def score(attempts: DataFrame, p: Params = DEFAULTS, explain: bool = False) -> DataFrame:
    """Attempts with signals, label and diagnosis; ``explain`` keeps the parsed values, equations and steps."""
    rows = with_diagnosis(signals(attempts, p), p).drop("found__", "hits__", "lhs__")
    return rows if explain else rows.drop(*PARSED[2:], "gold_scored")


def outcomes(attempts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Attempts with label and type, as ``score`` gives them, and what these always rest on (``RESTS_ON``).

    R, G and the reasons cost more than all else and few rows need them: R tells only among correct traces without
    any fault, G only among wrong ones that are close. They are valued where a rule asks, and are no columns here.
    """

    def texts() -> dict[str, Column]:
        trace, gold = F.coalesce("trace", F.lit("")), F.coalesce("gold_solution", F.lit(""))
        if p.normalize_traces:
            trace, gold = normalize_math(trace, p.vulgar_spacing), normalize_math(gold, p.vulgar_spacing)
        return {"trace_scored": trace, "gold_scored": gold}

    def parts() -> dict[str, Column]:
        return {
            "values__": N.extract_values(F.col("trace_scored")),
            "checkpoints__": N.checkpoint_results(F.col("gold_scored")),
            "stated__": N.stated(F.col("trace_scored")),
            "steps__": split_steps(F.col("trace_scored"), p.step_split_sentences),
            "final_answer": N.final_answer(F.col("trace_scored")),
        }

    def valued() -> dict[str, Column]:
        hits = how_many(F.col("checkpoints__"), lambda c: N.value_in(c, F.col("values__"), p.value_match_tol))
        return {"sides__": N.sides(F.col("stated__"), evaluate_all(N.left_sides(F.col("stated__"))), p.equation_tol), "hits__": hits}

    def counted() -> dict[str, Column]:
        eqs, tol = F.col("sides__"), p.value_match_tol
        right = how_many(eqs, lambda e: e["is_true"])
        coherent = F.when((F.size(eqs) > 0) & F.col("final_answer").isNotNull(), N.is_close(N.last(eqs)["c"], F.col("final_answer"), tol, tol))
        return {
            "right__": right, "n_equations": F.size(eqs), "n_steps": F.size("steps__"), "n_checkpoints": F.size("checkpoints__"), "coherent": coherent,
            "E": share(F.col("hits__"), F.size("checkpoints__"), 0), "correct": N.is_correct(F.col("final_answer"), F.col("gold_answer")),
        }

    def grounded() -> Column:
        return once(N.extract_values(F.coalesce("question", F.lit(""))), lambda asked: share(how_many(asked, lambda v: N.value_in(v, F.col("values__"), p.value_match_tol)), F.size(asked), 1))

    def label() -> dict[str, Column]:
        r = redundancy(F.col("steps__"), p.r_variant, p.dup_sim_threshold)
        found = L.classify(F.col("correct"), F.col("n_checkpoints") - F.col("hits__"), F.col("n_equations") - F.col("right__"), F.col("coherent"), r, grounded(), p)
        return {"label": found, "V": share(F.col("right__"), F.col("n_equations"), 0)}

    def kind() -> dict[str, Column]:
        names = ("E", "V", "n_steps", "n_checkpoints", "coherent", "n_equations")
        e, v, s, hat, coherent, n_eq = (F.col(c) for c in names)
        return {"diagnosis": F.when(L.needs_diagnosis(F.col("label")), L.failure_type(e, v, s, hat, grounded(), coherent, n_eq, p))}

    rows = attempts
    for make in (texts, parts, valued, counted, label, kind):
        rows = rows.withColumns(built((f"outcomes {make.__name__}", p), make))
    return rows.select(*attempts.columns, *RESTS_ON, "label", "diagnosis")


def rescored(attempts: DataFrame, before: str, rate=score, p: Params = DEFAULTS) -> DataFrame:
    """Attempts scored by ``rate``; what repeats the trace of ``before``, the same problem's earlier try (a struct of trace and scores), has its scores.

    Such rows are scored without texts, which costs next to nothing. They are not parted from the others, so nothing is generated twice.
    """
    read = ("question", "trace", "gold_solution")
    rows = attempts.withColumns({f"own_{c}__": F.col(c) for c in read} | {"same__": F.col("trace").eqNullSafe(F.col(f"{before}.trace"))})
    done = rate(rows.withColumns({c: F.when(~F.col("same__"), F.col(c)) for c in read}), p)
    own = [F.col(f"own_{c}__").alias(c) if c in read else F.col(c) for c in attempts.columns if c != before]
    new = [c for c in done.columns if c not in rows.columns]
    return done.select(*own, *[F.when(F.col("same__"), F.col(f"{before}.{c}")).otherwise(F.col(c)).alias(c) for c in new])


def signals_struct() -> Column:
    return F.struct(*(F.col(c) for c in SIGNALS)).alias("signals")


def diagnosis_counts(scored: DataFrame) -> DataFrame:
    """Rows by type with their share; good attempts count under GOOD."""
    counts = scored.groupBy(F.coalesce("diagnosis", F.lit("GOOD")).alias("ftype")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("ftype", "n", F.round(F.col("n") / total, 6).alias("share"))
