from functools import partial

import pytest
from pyspark.sql import functions as F

from marlstone.operators import runs
from marlstone.operators.score import FOUND, outcomes, rescored, score
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"
RIGHT, WRONG = "2 * 3 = 6\n#### 6", "2 * 3 = 7\n#### 7"


@pytest.mark.parametrize("rate", [score, outcomes])
def test_repeated_traces_have_their_earlier_scores(spark, rate):
    """F1, F2: what repeats a trace is not scored again, what does not is scored as ever."""
    rows = [("a", "How many are 2 bags of 3?", "<<2*3=6>>6", 6.0, RIGHT, WRONG), ("b", "How many are 2 bags of 3?", "<<2*3=6>>6", 6.0, WRONG, WRONG), ("c", None, None, None, None, None)]
    table = spark.createDataFrame(rows, "id string, question string, gold_solution string, gold_answer double, trace string, earlier string")
    first = rate(table.withColumn("trace", F.col("earlier")).drop("earlier"))
    scores = [c for c in FOUND if c in first.columns]
    planted = first.withColumn("label", F.concat(F.lit("earlier "), "label")).select("id", F.struct("trace", *scores).alias("before__"))
    got = rescored(table.drop("earlier").join(planted, "id"), "before__", rate)
    want = {r.id: r for r in rate(table.drop("earlier")).collect()}
    assert sorted(got.columns) == sorted(first.columns)
    for r in got.collect():
        expected = want[r.id].asDict() | {"label": ("" if r.id == "a" else "earlier ") + want[r.id].label}
        assert r.asDict() == expected


def test_lines_of_the_same_numbers_are_scored_once(spark, monkeypatch):
    """F3"""
    scored = []
    monkeypatch.setattr(registry, "score", lambda rows: scored.append(rows.count()) or score(rows))
    rows = registry.QUERIES["hard_signals"](spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert rows.count() == lines and scored and scored[0] < lines


def test_retry_prompts_need_no_redundancy(spark, monkeypatch):
    """F4"""
    monkeypatch.delattr(registry, "score")
    assert registry.QUERIES["retry_prompts"](spark, SF).count() > 0


def test_samples_rated_by_outcomes(spark):
    """rating, answer and type are those of the whole scoring."""
    problems = spark.createDataFrame([(f"p{i}", i, f"How many are {i} bags of 3?", f"<<{i}*3={3 * i}>>{3 * i}", 3.0 * i) for i in range(1, 5)], "id string, eval_index long, question string, gold_solution string, gold_answer double")

    def generate(asked):
        i = F.col("eval_index")
        total = (3 * i + (i + F.col("sample")) % 2).cast("string")
        return asked.withColumn("traces", F.array(F.concat(i.cast("string"), F.lit(" * 3 = "), total, F.lit("\n#### "), total)))

    run = partial(runs.run_samples, problems, 2, 3, 0.7, None, generate)
    told = ("id", "sample", "rating", "label", "diagnosis", "correct", "final_answer")
    whole, light = (rows.select(*told).orderBy("id", "sample").collect() for rows in (run(), run(rate=outcomes)))
    assert whole == light and len(light) == 12
