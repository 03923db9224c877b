"""Connected components of a link table by alternating large-star and small-star rounds.

Nothing is collected: a round is two aggregations and joins over the links, written to the shared
folder; the number of rounds grows with the logarithm of the links.  Minima are taken before rows are
sent, so a node with very many links costs no more than its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _sum_up(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """For each node of ``links`` (columns a, b) the least node it can reach: columns node, component.

    Links from a node to itself and null ends are ignored; repeated links count once.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v and a is not null and b is not null").distinct())
    before = _sum_up(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(small.where("u != v").distinct())
        drop(old)
        after = _sum_up(edges)
        if after == before:
            break
        before = after
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = cut(found.unionByName(roots))
    drop(edges)
    return out


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that gave ``known`` and of more; only what joins known components is walked anew."""
    a, b = (known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(between)
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("now"))
    old = known.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    out = cut(old.unionByName(more.join(known, "node", "left_anti").select("node", "component")))
    drop(more)
    return out
