"""What a trace says, as rows: values, checkpoints, equations and steps, with their places.

Each is a lateral join with a built-in table function, so a row of text becomes rows of what stands in it
without a shuffle; a text without any gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.steps import split_steps
from ..params import DEFAULTS, Params


def rows_of(table: DataFrame, found: Column, *keys: str) -> DataFrame:
    """``keys`` with ``place`` (from 0) and ``item`` for each element of an array of each row.

    Rows without any are dropped afterwards: a plain explode is given a filter on its array, which moves down to the scan
    and reads every text once more there, with whatever the text is made of.
    """
    named = table.select(*keys, found.alias("found__"))
    function = table.sparkSession.tvf.posexplode_outer(F.col("found__").outer()).toDF("place", "item")
    return named.lateralJoin(function).where(F.col("place").isNotNull()).select(*keys, "place", "item")


def value_rows(table: DataFrame, text: str, *keys: str) -> DataFrame:
    """Each distinct value that a text expresses."""
    return rows_of(table, N.extract_values(F.col(text)), *keys).withColumnRenamed("item", "value")


def checkpoint_rows(table: DataFrame, solution: str, *keys: str) -> DataFrame:
    """Each marked calculation of a solution."""
    return rows_of(table, N.gold_checkpoint_terms(F.col(solution)), *keys).select(*keys, "place", "item.*")


def equation_rows(table: DataFrame, trace: str, *keys: str, p: Params = DEFAULTS) -> DataFrame:
    """Each stated equation of a trace with the value of its left side (``a``) and the stated one (``c``)."""
    return rows_of(table, N.extract_equations(F.col(trace), p.equation_tol), *keys).select(*keys, "place", "item.*").drop("op", "b")


def step_rows(table: DataFrame, trace: str, *keys: str, p: Params = DEFAULTS) -> DataFrame:
    """Each step of a trace."""
    return rows_of(table, split_steps(F.col(trace), p.step_split_sentences), *keys).withColumnRenamed("item", "step")


def matched_values(values: DataFrame, wanted: DataFrame, tol: float, *keys: str) -> DataFrame:
    """The ``wanted`` rows (keys, value) with the ``values`` (keys, value) of the same keys that they are close to: a band join.

    Close is |a - b| <= tol * max(1, |a|, |b|).  A band holds the numbers of one size whose distance
    may be within the tolerance: powers of two are divided into steps of at least the
    tolerance, so close numbers lie in one band or in neighbours; a wanted value asks for three bands and
    the exact test follows.  A band's rows meet by an equi-join, whatever the number of values of a key.
    """
    values, wanted = (t.where(F.col("value").isNotNull() & ~F.isnan("value")) for t in (values, wanted))
    left = wanted.select(*keys, F.col("value").alias("wanted"), F.explode(F.array(*[band(F.col("value"), tol) + i for i in (-1, 0, 1)])).alias("band"))
    right = values.select(*keys, F.col("value").alias("near"), band(F.col("value"), tol).alias("band"))
    joined = left.join(right, [*keys, "band"])
    return joined.where(N.is_close(F.col("near"), F.col("wanted"), tol, tol)).select(*keys, "wanted", "near")


def band(value: Column, tol: float) -> Column:
    """The number of a value's band: steps of 2 * tol up to 1, and of a growth of 1 + 2 * tol beyond."""
    size = F.abs(value)
    steps = F.when(size <= 1, size / (2 * tol)).otherwise(F.floor(F.lit(1 / (2 * tol))) + F.log(size) / F.log(F.lit(1 + 2 * tol)))
    return F.when(size < float("inf"), F.floor(F.signum(value) * steps)).otherwise(F.signum(value) * 2.0**60).cast("long")
