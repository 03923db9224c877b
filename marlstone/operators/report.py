"""Run reports as text, from aggregates that are a few rows each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from . import aggregates as A

MOST_ROWS = 200


def small(table: DataFrame) -> list[list[str]]:
    """The cells of a small table; more than ``MOST_ROWS`` rows do not belong in a report."""
    rows = table.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")

    def cell(x) -> str:
        return "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)

    return [[cell(x) for x in r] for r in rows]


def as_markdown(table: DataFrame) -> str:
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns)
    return "\n".join([head, *("| " + " | ".join(r) + " |" for r in small(table))])


def as_console(table: DataFrame) -> str:
    """A small table in columns of equal width, the first to the left and the others to the right."""
    rows = [table.columns, *small(table)]
    widths = [max(len(r[i]) for r in rows) for i in range(len(table.columns))]
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(r, widths))).rstrip() for r in rows)


def crosstab_console(rows: DataFrame, row: str, column: str) -> str:
    """Counts of two columns with the totals of rows, columns and all."""
    cells = A.crosstab_totals(rows, row, column)
    named = cells.select(*[F.when(F.col("level").bitwiseAND(bit) > 0, "TOTAL").otherwise(F.coalesce(c, F.lit("-"))).alias(c) for c, bit in (("r", 2), ("c", 1))], "n")
    names = sorted(r.c for r in named.select("c").distinct().limit(MOST_ROWS).collect())
    order = [c for c in names if c != "TOTAL"] + ["TOTAL"]
    table = named.groupBy(F.col("r").alias(row)).pivot("c", order).agg(F.first("n")).na.fill(0)
    return as_console(table.orderBy(F.col(row) == "TOTAL", row))


def run_summary(first: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """One row with the figures of a run."""
    out = first.agg(F.count("*").alias("n_problems"), F.count_if("correct").alias("pass1_correct"), F.round(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)), 4).alias("pass1_acc"), *[F.count_if(F.col("label") == x).alias(x.lower()) for x in ("GOOD", "MEDIUM_CORRECT", "MEDIUM_WRONG", "BAD_WRONG")])
    if retries is None:
        return out
    more = retries.agg(F.count("*").alias("n_retries"), F.count_if("newly_correct").alias("recovered"), F.count_if("became_good").alias("became_good"))
    return out.join(F.broadcast(more)).withColumn("final_acc", F.round((F.col("pass1_correct") + F.col("recovered")) / F.greatest("n_problems", F.lit(1)), 4))


def run_report(first: DataFrame, retries: DataFrame | None = None, p: Params = DEFAULTS, extraction: DataFrame | None = None, cost: DataFrame | None = None) -> str:
    """A run in seven parts; those about retries, extraction and cost come if their tables are given, and
    recovery by type only if anything was recovered."""
    parts = [("Summary", run_summary(first, retries))]
    if retries is not None:
        from .runs import worthiness

        parts.append(("Retry-worthiness", worthiness(retries).orderBy("iter")))
        parts.append(("Transitions", A.retry_transitions(retries).orderBy("iter", "origin", "label")))
        by_type = A.recovery_by_type(retries).where("recovered > 0")
        if not by_type.isEmpty():
            parts.append(("Recovery by type", by_type))
        parts.append(("Gap", A.retry_gap(retries)))
    parts += [("Labels", A.histogram(first, "label", "id")), ("Types of failure", A.histogram(first.where("diagnosis is not null"), "diagnosis", "id")), ("Accuracy by category", A.by_category(first))]
    parts += [(title, table) for title, table in (("Extraction health", extraction), ("Cost", cost)) if table is not None]
    text = "\n\n".join(f"## {title}\n\n{as_markdown(table)}" for title, table in parts)
    return f"# Run report\n\n{text}\n\n## Settings\n\n```json\n{json.dumps(p.snapshot(), indent=2)}\n```\n"


def preliminary(first: DataFrame) -> DataFrame:
    """The summary that stands while retries are still running."""
    return run_summary(first).withColumns({"status": F.lit("pass1_complete_retries_pending"), "final_correct": F.col("pass1_correct"), "recovered_by_retry": F.lit(0)})


def stability_report(ratings: DataFrame, samples: DataFrame) -> str:
    from .stats import fleiss_kappa

    spread = A.agreement_per_item(ratings).agg(F.avg("modal_share").alias("modal_share"), F.avg("entropy").alias("entropy"), F.avg(F.col("all_same").cast("double")).alias("all_same"))
    parts = [("All outcomes", fleiss_kappa(ratings)), ("Wrong samples only", fleiss_kappa(ratings.where("rating != 'CORRECT'"))), ("Spread", spread), ("Accuracy", A.stability_accuracy(samples))]
    return "# Stability\n\n" + "\n\n".join(f"## {t}\n\n{as_markdown(x)}" for t, x in parts) + "\n"
