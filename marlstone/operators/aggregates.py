"""Counts, rates and outcome tables over attempt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import TYPED, UNCLASSIFIED, d, unclassified_cause, what_if
from ..functions.text import small_fraction
from ..params import DEFAULTS, Params

FULL_SPACE = ("CORRECT", *TYPED, UNCLASSIFIED)


def rate(k: Column, n: Column, empty: float = 0.0) -> Column:
    return F.when(n > 0, k / n).otherwise(d(empty))


def histogram(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Values by count, ties by first occurrence."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_pos"))
    return counts.orderBy(F.desc("n"), "first_pos")


def typed_failures(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("correct") & F.col("diagnosis").isin(*TYPED))


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total")).withColumn("acc", F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")), 4)).orderBy("category")


def crosstab_totals(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Cells with row, column and grand totals; ``level`` tells them apart."""
    return rows.cube(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("r", "c", F.col("level").cast("int").alias("level"), "n")


def extraction_report(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """How often the right value was there but not chosen (rows scored with ``explain``)."""
    wrong = ~F.col("correct")
    in_trace = F.exists("values__", lambda v: F.abs(v - F.col("gold_answer")) < d(1e-6))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("trace_scored").rlike("#{3,}")).alias("has_hash"),
        F.count_if(wrong & (F.col("E") >= d(0.8))).alias("high_e_wrong"),
        F.count_if(wrong & in_trace).alias("gold_present_wrong"),
    )


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Counts and means of each run of ``size`` rows in order (positions from 1)."""
    batch = F.floor((F.col(order) - 1) / size).alias("batch")
    return rows.groupBy(batch).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.avg("E").alias("mean_e"), F.avg("V").alias("mean_v"), F.avg("G").alias("mean_g"))


def sums_before(sums: DataFrame, keys: list[str], at: str, values: list[str], buckets: int, levels: int) -> DataFrame:
    """``sums`` (keys, at, values), one row for each ``at``, with ``<value>_before``: the sums of all rows of lower ``at``.

    A window holds ``buckets`` rows at most on all levels but the last: rows are summed by ranges of ``at``, these by ranges of ranges, and each level
    is told by the one above what lies before it.
    """
    up = f"up{levels}__"
    names = [f"{v}_before" for v in values]
    before = Window.partitionBy(*keys, *([up] if levels else [])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = [F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values]
    if not levels:
        return sums.withColumns(dict(zip(names, inner)))
    own = sums.withColumn(up, F.floor(F.col(at) / buckets))
    above = own.groupBy(*keys, up).agg(*[F.sum(v).alias(v) for v in values])
    told = sums_before(above, keys, up, values, buckets, levels - 1).drop(*values)
    told = told.select(*[F.col(c).alias(f"{c}_told") for c in [*keys, up]], *[F.col(n).alias(f"{n}_told") for n in names])
    on = F.col(up) == F.col(f"{up}_told")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_told"))
    joined = own.withColumns(dict(zip(names, inner))).join(told, on)
    return joined.select(*sums.columns, *[(F.col(n) + F.col(f"{n}_told")).alias(n) for n in names])


def running_accuracy(rows: DataFrame, order: str, group: str | None = None, buckets: int = 1024) -> DataFrame:
    """Accuracy up to each row, in order.

    Sums of ranges of the order are taken first, and sums of ranges of these, so that no window covers the
    whole table, with or without a group.
    """
    keys = [group] if group else []
    own = rows.withColumn("part__", F.floor(F.col(order) / buckets))
    sums = own.groupBy(*keys, "part__").agg(F.count("*").alias("n__"), F.count_if("correct").alias("k__"))
    sums = sums_before(sums, keys, "part__", ["n__", "k__"], buckets, 3).drop("n__", "k__")
    told = sums.select(*[F.col(c).alias(f"{c}_told") for c in [*keys, "part__"]], "n___before", "k___before")
    on = F.col("part__") == F.col("part___told")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_told"))
    inner = Window.partitionBy(*keys, "part__").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = own.withColumn("seen", F.count("*").over(inner)).withColumn("solved", F.sum(F.col("correct").cast("long")).over(inner))
    joined = counted.join(told, on).withColumn("seen", F.col("n___before") + F.col("seen")).withColumn("solved", F.col("k___before") + F.col("solved"))
    return joined.withColumn("running_acc", F.col("solved") / F.col("seen")).select(*rows.columns, "seen", "solved", "running_acc")


def solved_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("id")
    for t in tables[1:]:
        out = out.union(t.select("id"))
    return out.distinct()


def first_solves(rows: DataFrame, order: str) -> DataFrame:
    """Rows with whether they are the first correct one of their id."""
    w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("newly_correct", F.col("correct") & ~F.coalesce(F.max("correct").over(w), F.lit(False)))


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def final_outcomes(results: DataFrame) -> DataFrame:
    """A row per problem: its last first-pass row, and what later retries made of it.

    Columns of ``results``: line_no, phase (pass1 or retry), id, correct, label, newly_correct, became_good.
    """
    first = results.where("phase = 'pass1'").groupBy("id").agg(F.max(F.struct("line_no", "correct", "label")).alias("p"))
    retries = results.where("phase = 'retry'").select("id", F.col("line_no").alias("at"), "newly_correct", "became_good")
    later = first.join(retries, "id", "left").groupBy("id", "p").agg(
        F.coalesce(F.max(F.when(F.col("at") > F.col("p.line_no"), F.col("newly_correct"))), F.lit(False)).alias("recovered"), F.count_if(F.col("at") > F.col("p.line_no")).alias("n_retries")
    )
    return later.select("id", F.col("p.correct").alias("pass1_correct"), F.col("p.label").alias("pass1_label"), "recovered", (F.col("p.correct") | F.col("recovered")).alias("final_correct"), "n_retries")


def retry_transitions(retries: DataFrame) -> DataFrame:
    return retries.groupBy("iter", "origin", "label").agg(F.count("*").alias("n"), F.count_if("newly_correct").alias("newly_correct"))


def recovery_by_type(retries: DataFrame) -> DataFrame:
    return retries.groupBy("prev_diagnosis").agg(F.count("*").alias("tried"), F.count_if("newly_correct").alias("recovered")).orderBy(F.desc("recovered"), "prev_diagnosis")


def retry_gap(retries: DataFrame) -> DataFrame:
    """Recovery of the MEDIUM queue less that of the BAD queue; also over wrong rows only."""
    def share(origin: str, among: Column) -> Column:
        mine = (F.col("origin") == origin) & among
        return F.count_if(mine & F.col("newly_correct")) / F.greatest(F.count_if(mine), F.lit(1))

    every, wrong = F.lit(True), F.col("prev_label") != "MEDIUM_CORRECT"
    return retries.agg(F.round(share("MEDIUM", every) - share("BAD", every), 4).alias("gap"), F.round(share("MEDIUM", wrong) - share("BAD", wrong), 4).alias("gap_wrong_only"))


def cost(rows: DataFrame, n_full: int = 7473) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    per = F.sum("gen_seconds") / n
    return rows.agg(F.count("*").alias("generations"), F.sum("gen_tokens").alias("tokens"), per.alias("sec_per_gen"), (per * n_full / 3600).alias("projected_gpu_h"))


def signal_columns() -> list[Column]:
    return [F.col(c) for c in ("E", "V", "n_steps", "n_checkpoints", "G", "coherent", "n_equations")]


def abstain_breakdown(diagnosed: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows without a type: in the abstain band by E, the others by what blocked their rule."""
    e, v, s, hat, g, coh, n_eq = signal_columns()
    rows = diagnosed.where(F.col("diagnosis") == UNCLASSIFIED)
    band = F.contains(F.coalesce("diagnosis_reason", F.lit("")), F.lit("abstain"))
    value = F.round(e, 3)
    what = F.when(band, F.concat(F.lit("E="), F.format_string("%.3f", value))).otherwise(unclassified_cause(e, v, s, hat, coh, g, n_eq, p))
    return rows.groupBy(band.alias("in_band"), what.alias("cause")).agg(F.count("*").alias("n"), F.first(F.when(band, small_fraction(value)).otherwise("")).alias("fraction"))


def still_abstaining(diagnosed: DataFrame, margins: tuple[float, ...] = (0.02, 0.01, 0.0), p: Params = DEFAULTS) -> DataFrame:
    rows = diagnosed.where((F.col("diagnosis") == UNCLASSIFIED) & F.contains(F.coalesce("diagnosis_reason", F.lit("")), F.lit("abstain")))
    counts = rows.agg(F.array(*[F.struct(d(m).alias("margin"), F.count_if(F.abs(F.col("E") - d(p.sm_e_max)) < d(m)).alias("n")) for m in margins]).alias("c"))
    return counts.select(F.explode("c").alias("x")).select("x.margin", "x.n")


# Name, margin and whether the fifth type is on.
SCENARIOS = (("current", 0.05, False), ("margin=0.02", 0.02, False), ("margin=0.00", 0.0, False), ("margin=0.02 + WP 5th type", 0.02, True))


def what_if_margins(diagnosed: DataFrame, scenarios=SCENARIOS, p: Params = DEFAULTS) -> DataFrame:
    """Types under other margins; every row is diagnosed once per scenario, in place."""
    found = F.array(*[F.struct(F.lit(name).alias("scenario"), what_if(*signal_columns(), d(margin), F.lit(wp), p).alias("ftype")) for name, margin, wp in scenarios])
    return diagnosed.select(F.explode(found).alias("x")).groupBy("x.scenario", "x.ftype").agg(F.count("*").alias("n"))


def majority_vote(answers: DataFrame, group: str, answer: str, order: str) -> DataFrame:
    """The commonest answer of each group; null answers do not vote, ties go to the first seen."""
    counts = answers.where(F.col(answer).isNotNull()).groupBy(group, answer).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(group).agg(F.max_by(answer, F.struct("n", (-F.col("first")).alias("f"))).alias("vote"), F.max("n").alias("votes"))
    return answers.select(group).distinct().join(best, group, "left")


def agreement_per_item(ratings: DataFrame) -> DataFrame:
    """Share of the commonest rating, entropy in bits and whether all ratings are the same."""
    counts = ratings.groupBy("item", "rating").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("item"))
    shares = counts.select("item", (F.col("n") / size).alias("q"))
    return shares.groupBy("item").agg(F.max("q").alias("modal_share"), F.sum(-F.col("q") * F.log2("q")).alias("entropy"), (F.count("*") == 1).alias("all_same"))


def stability_accuracy(samples: DataFrame) -> DataFrame:
    """First-sample, majority and any-sample accuracy over rows (item, pos, answer, gold, correct)."""
    voted = majority_vote(samples, "item", "answer", "pos")
    per_item = samples.groupBy("item").agg(F.min_by("correct", "pos").alias("first"), F.max("correct").alias("any"), F.first("gold").alias("gold"))
    joined = per_item.join(voted, "item")
    right = F.coalesce(F.abs(F.col("vote") - F.col("gold")) < d(1e-6), F.lit(False))
    return joined.agg(F.count("*").alias("n"), F.avg(F.col("first").cast("double")).alias("acc_at_1"), F.avg(right.cast("double")).alias("majority_at_k"), F.avg(F.col("any").cast("double")).alias("pass_at_k"))


def method_table(rows: DataFrame) -> DataFrame:
    """Accuracy of each method over the ids it evaluated, last row per id."""
    last = rows.groupBy("method", "id").agg(F.max_by("correct", "line_no").alias("correct"))
    return last.groupBy("method").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct")).withColumn("acc", F.round(F.col("correct") / F.col("n"), 4)).orderBy(F.desc("acc"), "method")


def first_with_vote(samples: DataFrame, group: str, answer: str, order: str) -> DataFrame:
    """The first sample of each group that gave the commonest answer, and how many agree; none where nobody voted."""
    voted = majority_vote(samples, group, answer, order).where("vote is not null")
    agreeing = samples.join(voted, group).where(F.col(answer) == F.col("vote"))
    return agreeing.groupBy(group).agg(F.min(order).alias("first_pos"), F.first("vote").alias("vote"), F.first("votes").alias("votes"))
