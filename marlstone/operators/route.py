"""Buckets of stored traces: routing, deduplicated appends, resumption and what examples may show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import bucket

SECRET = ("gold_solution", "gold_answer", "ground_truth")


def routed(scored: DataFrame) -> DataFrame:
    """Records with their bucket and complexity."""
    return scored.withColumns({"bucket": bucket(F.col("label")), "complexity": F.col("n_checkpoints")})


def new_records(records: DataFrame, stored: DataFrame, order: str = "eval_index") -> DataFrame:
    """Records whose id their bucket does not have yet; of several with one id the first."""
    fresh = records.join(stored.select("bucket", "id"), ["bucket", "id"], "left_anti")
    return fresh.groupBy("bucket", "id").agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")


def append_records(records: DataFrame, path: str, order: str = "eval_index") -> None:
    """Idempotent append to a store partitioned by bucket."""
    from ..sources.tables import read_store

    stored = read_store(records.sparkSession, path, records.schema)
    new_records(records, stored, order).write.mode("append").partitionBy("bucket").parquet(path)


def remaining(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id is not among the done ones."""
    return rows.join(done.select("id").distinct(), "id", "left_anti")


def retry_queue(stored: DataFrame) -> DataFrame:
    """Stored failures that no pooled trace has solved, the medium bucket before the bad one."""
    pool = stored.where("bucket = 'pool'").select("id").distinct()
    queue = stored.where("bucket in ('medium', 'bad')").join(pool, "id", "left_anti")
    return queue.withColumn("origin", F.upper("bucket")).withColumn("turn", F.when(F.col("bucket") == "medium", 0).otherwise(1))


def sanitized(exemplars: DataFrame) -> DataFrame:
    """Without the columns that give the answer away."""
    return exemplars.drop(*SECRET)


def exemplars(stored: DataFrame) -> DataFrame:
    return sanitized(stored.where("bucket = 'pool'"))


def bucket_counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("bucket").agg(F.count("*").alias("n"))


def without_seeds(problems: DataFrame, seeds: DataFrame) -> DataFrame:
    """Problems whose question is no seed's."""
    return problems.join(seeds.select("question").distinct(), "question", "left_anti")


def assert_disjoint(problems: DataFrame, seeds: DataFrame) -> DataFrame:
    """``problems``, failing at run time on a question that is also a seed's."""
    marked = seeds.select("question", F.lit(True).alias("is_seed__")).distinct()
    joined = problems.join(marked, "question", "left")
    return joined.where(F.when(F.col("is_seed__"), F.raise_error(F.concat(F.lit("seed in evaluation: "), "question")).cast("boolean")).otherwise(F.lit(True))).drop("is_seed__")


def find_item(quality: DataFrame, errors: DataFrame, item_id: str) -> DataFrame:
    """The first item with an id, quality items before errors; fails if there is none."""
    both = quality.withColumn("section", F.lit("quality_set")).unionByName(errors.withColumn("section", F.lit("error_set")), allowMissingColumns=True)
    found = both.where(F.col("id") == item_id).orderBy(F.desc("section")).limit(1)
    if found.isEmpty():
        raise LookupError(f"no item with id {item_id}")
    return found


def with_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """The rows whose id begins with a prefix."""
    return rows.where(F.startswith("id", F.lit(prefix)))
