"""Retries: which examples each arm shows, and the prompts of a queue.

What a typed arm shows depends on the type alone, so the lists are made once per type and joined to the
queue; they hold at most types x budget rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.question import names_target
from ..functions.rules import CE, INSTRUCTION, NR, SM, ST, TYPED, UNCLASSIFIED, d, looked_up
from ..functions.text import lines
from .prompts import HEADER, example_block, joined

ARMS = {"typed": 0.0, "generic": 0.0, "immediate": 0.8}
WORDS = {"simple": 2, "medium": 4, "complex": 6}


def typed_rule(ftype: str, has_signals: bool) -> Column:
    """Which records are examples for a type; records without signals are judged by their texts."""
    trace = F.coalesce("trace", F.lit(""))
    n_lines = F.size(F.filter(lines(trace), lambda s: ~F.startswith(s, F.lit("####"))))
    n_eq, n_steps, v = F.regexp_count(trace, F.lit("=")), n_lines, d(1)
    hat = n_steps
    if has_signals:
        n_eq, n_steps, v = F.coalesce("signals.n_equations", n_eq), F.coalesce("signals.n_steps", n_steps), F.coalesce("signals.V", d(1))
        hat = F.coalesce("signals.n_checkpoints", hat)
    naming = names_target(F.col("question"), trace)
    return {
        NR: (n_eq <= 2) & naming,
        SM: (F.regexp_count("question", F.lit(r"[0-9]+(?:\.[0-9]+)?")) >= 3) & (n_eq <= 2) & naming,
        CE: (v >= d(0.85)) & (n_eq >= 1),
        ST: n_steps >= F.greatest(hat, F.lit(1)),
    }.get(ftype, F.lit(False))


def typed_candidates(records: DataFrame, ftype: str) -> DataFrame:
    return records.where(typed_rule(ftype, "signals" in records.columns))


def first_k(rows: DataFrame, k: int, order: str = "pos") -> DataFrame:
    return rows.orderBy(order).limit(k)


def filled(parts: list[DataFrame], k: int) -> DataFrame:
    """The first k of the parts in turn; what repeats a question of an earlier part is left out."""
    cols = ["question", "trace", "pos"]
    rows = reduce(lambda a, b: a.unionByName(b), [part.select(*cols).withColumn("prio", F.lit(i)) for i, part in enumerate(parts)])
    first = F.min("prio").over(Window.partitionBy("question"))
    seen = F.row_number().over(Window.partitionBy("question", "prio").orderBy("pos"))
    kept = rows.withColumn("first__", first).withColumn("seen__", seen).where((F.col("prio") == 0) | ((F.col("prio") == F.col("first__")) & (F.col("seen__") == 1)))
    return kept.orderBy("prio", "pos").limit(k).withColumn("place", F.row_number().over(Window.orderBy("prio", "pos"))).drop("first__", "seen__")


def positives(pool: DataFrame, seeds: DataFrame, arm: str, budget: int = 8) -> DataFrame:
    """Examples by type and place.  Each list is of at most ``budget`` rows."""
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm!r}")
    kinds = (*TYPED, UNCLASSIFIED)
    any_seed = first_k(seeds, 2 * budget)
    if arm == "immediate":
        shared = filled([first_k(seeds, budget)], budget)
    elif arm == "generic":
        recent = pool.orderBy(F.desc("pos")).limit(budget)
        shared = filled([recent, any_seed], budget)
    else:
        per_kind = []
        for kind in kinds:
            own, more = first_k(typed_candidates(pool, kind), budget), first_k(typed_candidates(seeds, kind), 2 * budget)
            per_kind.append(filled([own, more, any_seed], budget).withColumn("ftype", F.lit(kind)))
        return reduce(lambda a, b: a.unionByName(b), per_kind)
    return shared.withColumn("ftype", F.explode(F.array(*[F.lit(k) for k in kinds])))


def retry_prompts(queue: DataFrame, shown: DataFrame, arm: str) -> DataFrame:
    """The queue with the prompt, system line and temperature of an arm; the type's line is no part of the prompt."""
    lists = shown.groupBy("ftype").agg(F.array_sort(F.collect_list(F.struct("place", "question", "trace"))).alias("examples"))
    kind = F.coalesce("diagnosis", F.lit(UNCLASSIFIED))
    rows = queue.withColumn("ftype", kind).join(F.broadcast(lists), "ftype", "left")
    examples = F.coalesce("examples", F.array().cast(lists.schema["examples"].dataType))
    text = joined(HEADER, example_block(examples, F.size(examples)), "Question: ", F.col("question"), "\nSolution:")
    line = looked_up(F.col("ftype"), INSTRUCTION) if arm == "typed" else F.lit("")
    return rows.withColumns({"prompt": text, "extra_system": F.coalesce(line, F.lit("")), "temperature": d(ARMS[arm]), "typed_positives": F.size(examples)}).drop("examples")
