"""Merkle manifest of a dataset: digests of its rows, of each group and of the whole, with proofs.

A row is a leaf.  In each group the leaves, in the order of their key, are the lowest nodes; every ``ARITY``
consecutive nodes become the digest of their concatenated digests, their *preimage*, until one node is left.
The groups' last nodes make a tree of the same kind, whose last node is the root.

A parent's preimage holds all that is to be known of its children: a node's siblings are the preimage
without the node's own 64 characters, and a changed node is spliced into them.  So each parent of leaves is
given the preimages of its ancestors, from above, one level a join, and the leaves, sixteen a parent, join
that path once.  No step has a group of more than ``ARITY`` rows: places in a group come from a range
partitioning and a table of one row for each group and part, so a group may hold any share of the rows.

Defined results: nulls are ``-`` in a leaf's input; a null group is a group, before all others; a null
key comes first in its group and is not tampered with; rows of one key are in the order of their leaves, so repeated
rows are leaves of their own with the same values; an empty table gives no rows; columns that are not
asked for are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, partitions

ARITY, DIGEST = 16, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5
PATH = "array<struct<slot:int,preimage:string>>"


def framed(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*(framed(c) for c in fields.values()))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``idx``, the place in the group from 0, and ``n``, the rows of the group; also gives the largest ``n``.

    ``rows`` are range-partitioned and sorted once; what is windowed has one row for each group and part.
    """
    count = partitions(rows.sparkSession)
    dealt = rows.repartitionByRange(count, *group, *order).sortWithinPartitions(*group, *order)
    ranged = cut(dealt.withColumn("at", F.monotonically_increasing_id()))  # the part above bit 33, the row's place in it below
    part = F.shiftright("at", 33)
    runs = ranged.groupBy(*group, part.alias("part")).agg(F.count("*").alias("own"), F.min("at").alias("first"))
    all_parts = Window.partitionBy(*group)
    before = F.sum("own").over(all_parts.orderBy("part")) - F.col("own")
    runs = cut(runs.select(*group, "part", (before - F.col("first")).alias("shift"), F.sum("own").over(all_parts).alias("n")))
    most = runs.agg(F.max("n").alias("n")).first().n or 0
    named = runs.select(*[F.col(c).alias(f"{c}_of_run") for c in group], "part", "shift", "n")
    on = F.shiftright(ranged["at"], 33) == named["part"]
    for c in group:
        on = on & ranged[c].eqNullSafe(named[f"{c}_of_run"])
    return ranged.join(named, on).select(*[ranged[c] for c in rows.columns], (F.col("at") + F.col("shift")).alias("idx"), "n"), most


def levels_above(nodes: DataFrame, group: list[str], most: int) -> list[DataFrame]:
    """The parents of ``nodes`` (group, idx, hash, n), level by level, with their preimages."""
    found = []
    while most > 1:
        ordered = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        preimage = F.array_join(F.transform(ordered, lambda x: x["hash"]), "")
        parents = nodes.where("n > 1").groupBy(*group, F.expr(f"idx div {ARITY}").alias("idx")).agg(preimage.alias("preimage"), F.expr(f"(max(n) + {ARITY - 1}) div {ARITY}").alias("n"))
        nodes = cut(parents.select(*group, "idx", "n", "preimage", F.sha2("preimage", 256).alias("hash")))
        found.append(nodes)
        most = -(-most // ARITY)
    return found


def given_paths(nodes: DataFrame, above: DataFrame, group: list[str], carried: list[str]) -> DataFrame:
    """``nodes``, each with its parent's preimage before its parent's path."""
    up = above.select(F.col("idx").alias("idx_above"), F.col("preimage").alias("preimage_above"), F.col("path").alias("path_above"), *[F.col(c).alias(f"{c}_above") for c in [*group, *carried]])
    on = F.expr(f"idx div {ARITY}") == F.col("idx_above")
    for c in group:
        on = on & nodes[c].eqNullSafe(up[f"{c}_above"])
    own = F.struct((F.col("idx") % ARITY).cast("int").alias("slot"), F.col("preimage_above").alias("preimage"))
    return nodes.join(up, on).select(*nodes.columns, *[F.col(f"{c}_above").alias(c) for c in carried], F.concat(F.array(own), F.col("path_above")).cast(PATH).alias("path"))


def with_paths(nodes: DataFrame, parents: list[DataFrame], group: list[str], last, carried: list[str]) -> DataFrame:
    """``nodes`` with the path of each and the ``carried`` columns; ``last`` gives both to the last node of a group."""
    above = None
    for level in [*reversed(parents), nodes]:
        ends = last(level.where("n = 1"))
        above = ends if above is None else ends.unionByName(given_paths(level.where("n > 1"), above, group, carried))
    return above


def without(step: Column) -> tuple[Column, Column]:
    """What stands before and after a node's own digest in its parent's preimage."""
    at = step["slot"] * DIGEST
    return F.substr(step["preimage"], F.lit(1), at), F.substr(step["preimage"], at + DIGEST + 1)


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(*without(s))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(below: Column, step: Column) -> Column:
        before, after = without(step)
        return digest(before, below, after)

    return F.aggregate(path, leaf, up)


def manifest(leaves: DataFrame, group: str, key: str) -> DataFrame:
    """``leaves`` (group, key, leaf and further columns) with ``subroot``, ``root`` and ``path``: for each level from
    below the node's slot in its parent and the parent's preimage."""
    rows, most = numbered(leaves, [group], [key, "leaf"])
    nodes = cut(rows.withColumn("hash", F.col("leaf")))
    parents = levels_above(nodes, [group], most)
    ends = None
    for level in [nodes, *parents]:
        own = level.where("n = 1").select(group, F.col("hash").alias("subroot"))
        ends = own if ends is None else ends.unionByName(own)
    tops, most_tops = numbered(ends, [], [group])
    tops = cut(tops.withColumn("hash", F.col("subroot")))
    top_parents = levels_above(tops, [], most_tops)

    def the_root(node: DataFrame) -> DataFrame:
        return node.select("*", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))

    found = cut(with_paths(tops, top_parents, [], the_root, ["root"]).select(F.col(group).alias("of_group"), "subroot", "root", "path"))

    def its_group(node: DataFrame) -> DataFrame:
        return node.join(found, node[group].eqNullSafe(found["of_group"])).select(*node.columns, "subroot", "root", "path")

    drop(*top_parents)
    return with_paths(nodes, parents, [group], its_group, ["subroot", "root"]).drop("idx", "n", "hash")


def verified_documents(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source, the proof of each and what a tampered text makes of it."""
    given = {c: F.col(c) for c in FIELDS}
    lowered = given | {"text": F.translate("text", UPPER, LOWER)}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, F.lit(False))
    leaves = docs.select("doc_id", "source", leaf_of(given).alias("leaf"), F.when(touched, leaf_of(lowered)).alias("tampered"))
    proved = manifest(cut(leaves), "source", "doc_id")
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
