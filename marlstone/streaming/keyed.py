"""What is new in a stream, kept as state by key: first records of a bucket and first solves of an id.

The state of a key is one row, so an append neither reads the store nor asks it what it has, a batch that
comes again adds nothing, and a query that is started again from its checkpoint goes on where it was.
Rows of one key that come in one batch are taken in their order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import shared_folder


def whole(parts: Iterable[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True)


def first_records(records: DataFrame, order: str = "eval_index") -> DataFrame:
    """Records whose (bucket, id) has not come before; of several in a batch the first."""

    def treat(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        state.update((True,))
        yield whole(parts).sort_values(order, kind="stable").head(1)

    return records.groupBy("bucket", "id").applyInPandasWithState(treat, records.schema, "stored boolean", "append", GroupStateTimeout.NoTimeout)


def first_solves(attempts: DataFrame, order: str) -> DataFrame:
    """All attempts (id, correct, ...) with whether they are the first correct one of their id."""
    schema = T.StructType([*attempts.schema.fields, T.StructField("newly_correct", T.BooleanType())])

    def treat(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = whole(parts).sort_values(order, kind="stable")
        solved = state.exists
        right = rows["correct"].fillna(False).astype(bool)
        rows["newly_correct"] = right & (right.cumsum() == 1) & (not solved)
        if right.any() and not solved:
            state.update((True,))
        yield rows

    return attempts.groupBy("id").applyInPandasWithState(treat, schema, "solved boolean", "append", GroupStateTimeout.NoTimeout)


def append_new(records: DataFrame, store: str, checkpoint: str, order: str = "eval_index"):
    """Start to append a stream's new records to a store partitioned by bucket; ends when what is there has been read."""
    new = first_records(records, order)
    return new.writeStream.format("parquet").partitionBy("bucket").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(store)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives of what is there, as a table."""
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A written table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
