"""Attempts rendered from orders and their lines, each with a known kind of fault.

An order is a question about all its lines (a quantity and a small price each); its solution lists the
products and their sum.  ``o_orderkey % 8`` picks what is wrong with the trace.  An order without lines
is an attempt with an empty solution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's priority, id and its lines in order.

    Lines and orders are dealt by key to as many parts as shuffles have, and stay there: rendering and
    scoring make rows much longer than they are here, so parts are not joined, nor the lines broadcast.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    q, price = F.col("l_quantity").cast("int"), (1 + F.col("l_partkey") % 97).cast("int")
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.struct(*place, q.alias("q"), price.alias("p")).alias("line"))
    grouped = lines.repartition(parts, "key").groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("sorted"))
    numbered = F.transform("sorted", lambda x, i: F.struct((i + 1).alias("rn"), x["q"].alias("q"), x["p"].alias("p")))
    grouped = grouped.select("key", numbered.alias("lines"))
    none = F.array().cast(grouped.schema["lines"].dataType)
    return orders.repartition(parts, "key").join(grouped.hint("merge"), "key", "left").withColumn("lines", F.coalesce("lines", none))


def product(line: Column) -> Column:
    return line["q"] * line["p"]


def total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda acc, x: acc + product(x))


def text(*parts) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def question(priority: Column, lines: Column) -> Column:
    def each(*parts) -> Column:
        return F.array_join(F.transform(lines, lambda x: text(*(x[c] if c in ("q", "p") else c for c in parts))), ", ")

    return (
        F.when(priority == "1-URGENT", text("A shop buys ", each("q", " boxes at $", "p"), ". What is the total cost?"))
        .when(priority == "2-HIGH", text("A job has ", each("q", " rounds of ", "p", " minutes"), ". Find the full duration."))
        .when(priority == "3-MEDIUM", text("A van goes ", each("q", " trips of ", "p", " miles"), " at constant speed. Find the full distance."))
        .when(priority == "4-NOT SPECIFIED", text("How many beads are in ", each("q", " bags of ", "p", " beads"), "?"))
        .otherwise(text("A box holds ", each("q", " rows of ", "p", " pins"), ". Ignore the percent sign."))
    )


def solution(lines: Column) -> Column:
    steps = F.transform(lines, lambda x: text("<<", x["q"], "*", x["p"], "=", product(x), ">>", product(x)))
    return text(F.array_join(steps, "\n"), "\n#### ", total(lines))


def trace(kind: Column, lines: Column) -> Column:
    n, whole = F.size(lines), total(lines)

    def step(x: Column, result: Column) -> Column:
        return text(x["q"], " * ", x["p"], " = ", result)

    def worked(shown: Column, results: Column, last: Column) -> Column:
        parts = F.concat(shown, F.array(text(F.array_join(results.cast("array<string>"), " + "), " = ", last)))
        return F.when(n > 0, F.array_join(parts, "\n")).otherwise("")

    plain = F.transform(lines, lambda x: step(x, product(x)))
    results = F.transform(lines, product)
    more = F.transform(lines, lambda x: F.struct((x["q"] + 1).alias("q"), x["p"].alias("p")))
    off = F.transform(lines, lambda x: product(x) + F.when(x["rn"] == n, 7).otherwise(0))
    slipped = F.zip_with(lines, off, lambda x, r: step(x, r))
    few = F.floor(n / 3).cast("int")

    def answered(body: Column, answer: Column) -> Column:
        return text(body, "\n#### ", answer)

    return (
        F.when(kind == 1, answered(worked(slipped, off, whole + 7), whole + 7))
        .when(kind == 2, answered(F.array_join(F.slice(plain, 1, few), "\n"), whole + 1))
        .when(kind == 3, answered(F.lit("We think about it and guess."), whole + 3))
        .when(kind == 4, answered(worked(plain, results, whole), whole + 5))
        .when(kind == 5, answered(worked(F.concat(F.slice(plain, 1, 1), F.slice(plain, 1, 1), plain), results, whole), whole))
        .when(kind == 6, answered(worked(F.slice(plain, 1, n - 1), results, whole), whole))
        .when(kind == 7, answered(worked(F.transform(more, lambda x: step(x, product(x))), F.transform(more, product), total(more)), total(more)))
        .otherwise(answered(worked(plain, results, whole), whole))
    )


def attempt_id(key: Column) -> Column:
    return text("p1_", F.lpad(key.cast("string"), 8, "0"))


def rendered(rows: DataFrame, kind: Column, *kept: str) -> DataFrame:
    """Attempts of the given kind for ``items`` rows."""
    return rows.select(
        *kept,
        attempt_id(F.col("key")).alias("id"),
        F.col("key").alias("eval_index"),
        "priority",
        question(F.col("priority"), F.col("lines")).alias("question"),
        solution(F.col("lines")).alias("gold_solution"),
        total(F.col("lines")).cast("double").alias("gold_answer"),
        trace(kind, F.col("lines")).alias("trace"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts."""
    return rendered(items(spark, sf_dir), F.col("key") % 8)


def faultless(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Attempts without fault of the keys that are asked for (key)."""
    return rendered(items(spark, sf_dir).join(asked, "key", "left_semi"), F.lit(0))
