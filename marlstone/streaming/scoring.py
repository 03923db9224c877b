"""Streaming twins: scoring attempts as they arrive, and live counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.route import append_records, routed
from ..operators.score import score
from ..params import DEFAULTS, Params

ATTEMPTS = "id string, eval_index long, question string, gold_solution string, gold_answer double, trace string, stored_at timestamp"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def score_into_store(attempts: DataFrame, store: str, checkpoint: str, p: Params = DEFAULTS) -> StreamingQuery:
    """Score each micro-batch and append what its buckets do not have; a batch that runs again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        append_records(routed(score(batch, p)), store)

    return attempts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_id(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An extension: drop repeated ids within a watermark, with state bounded by the delay."""
    return attempts.withWatermark("stored_at", delay).dropDuplicatesWithinWatermark(["id"])


def live_counts(scored: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """An extension: labels per window of arrival."""
    return scored.withWatermark("stored_at", delay).groupBy(F.window("stored_at", window), "label").agg(F.count("*").alias("n"))
