"""Readers and writers of attempt tables: JSON lines, single documents, CSV and partitioned stores."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import gold_answer_value
from ..functions.rules import confident
from ..functions.text import clean_question, normalize_math

SIGNALS = "struct<E:double,V:double,R:double,A:double,G:double,coherent:boolean,correct:boolean,final_answer:double,misses:int,bad_eqs:int,n_steps:int,n_checkpoints:int,n_equations:int,r_variant:string,E_struct:double,A_struct:double>"
CATEGORY = "struct<category_type:string,complexity:string,main_operation:string,estimated_steps:int,keyword_hits:array<string>>"
#: Rows of both phases of a run.
RESULTS = (
    f"phase string, id string, eval_index int, question string, gold_solution string, gold_answer double, category {CATEGORY}, prompt_tokens int, gen_seconds double, gen_tokens int, "
    f"trace string, trace_scored string, signals {SIGNALS}, label string, diagnosis string, diagnosis_reason string, diagnosis_confidence double, iter int, origin string, retry_mode string, "
    "prev_label string, prev_diagnosis string, typed_positives int, instruction string, became_good boolean, newly_correct boolean"
)
SAMPLES = f"array<struct<trace:string,rating:string,correct:boolean,label:string,diagnosis:string,diagnosis_confidence:double,signals:{SIGNALS}>>"
STABILITY = f"id string, question string, gold_answer double, category string, k int, temperature double, samples {SAMPLES}"
BASELINE = "id string, correct boolean, pass1_correct boolean, category string, pred double, gold double"
GOLDEN = "struct<id:string,question:string,trace:string,gold_solution:string,gold_answer:double,note:string,human_expected_label:string,human_expected_diagnosis:string>"
DOCUMENT = f"quality_set array<{GOLDEN}>, error_set array<{GOLDEN}>"



def read_lines(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema; a missing file is an empty table, a bad line fails or is dropped."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    try:
        return spark.read.schema(ddl).option("mode", mode).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ddl)
        raise


def read_document(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A file that is one JSON document."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def golden_items(document: DataFrame, section: str) -> DataFrame:
    return document.select(F.explode(section).alias("x")).select("x.*")


def preprocess(problems: DataFrame) -> DataFrame:
    done = {}
    if "question" in problems.columns:
        done["question"] = clean_question(F.col("question"))
    if "answer" in problems.columns:
        done["answer"] = normalize_math(F.col("answer"))
    return problems.withColumns(done)


def problems(rows: DataFrame, n: int | None = None, order: str = "eval_index", offset: int = 0) -> DataFrame:
    """Problems with a readable answer, optionally the first n of them in order."""
    kept = preprocess(rows).withColumn("gold_answer", gold_answer_value(F.col("answer"))).where(F.col("gold_answer").isNotNull())
    if n is None:
        return kept
    return kept.orderBy(order).offset(offset).limit(n)


def first_pass(results: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """The gate's view of first-pass rows."""
    kind = confident(F.col("diagnosis"), F.col("diagnosis_confidence"), min_confidence) if min_confidence > 0 else F.col("diagnosis")
    return results.where("phase = 'pass1'").select(
        "id", "question", F.coalesce("category.category_type", F.lit("unknown")).alias("category"), F.coalesce("signals.correct", F.lit(False)).alias("correct"), "label", kind.alias("diagnosis"), F.col("diagnosis_confidence").alias("confidence")
    )


def diagnosed(results: DataFrame, phase: str | None = "pass1") -> DataFrame:
    rows = results.where(F.col("phase") == phase) if phase else results
    return rows.where("diagnosis is not null")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a file that may end in a broken line."""
    return read_lines(spark, path, "id string", strict=False).where("id is not null").distinct()


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def one_document(row: DataFrame) -> str:
    """A table of one row as a JSON document."""
    return json.dumps(json.loads(row.select(F.to_json(F.struct("*")).alias("j")).first().j), indent=2)


def kept(spark: SparkSession, folder: str, parameters: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written once for each set of parameters and read from then on."""
    name = "-".join(f"{k}={parameters[k]}" for k in sorted(parameters)) or "all"
    path = f"{folder}/{re.sub(r'[^A-Za-z0-9=._-]', '_', name)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def generated(prompts: DataFrame, generate: Callable, schema: str) -> DataFrame:
    """Traces from an external generator: a function from an iterator of pandas frames to the same."""
    return prompts.mapInPandas(generate, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back: what several consumers read is computed once,
    and a lost executor costs no recomputation."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Growing:
    """A staged table that grows by appended parts and is read as one: a part costs what it holds, and what was
    read before an append does not change."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", None

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)
        self.schema = rows.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
