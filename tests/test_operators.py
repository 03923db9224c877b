import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.question import CATEGORIES
from marlstone.operators import aggregates, prompts, report, retrieve, retry, route, seeds, stats
from marlstone.operators.score import RESTS_ON, outcomes, score
from marlstone.plans import attempts, registry
from marlstone.sources import tables
from marlstone.streaming import scoring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def scored(spark):
    rows = attempts.attempts(spark, SF).where("eval_index % 7 = 0")
    return score(rows).withColumn("category", F.lit("time")).cache()


def test_score_invariants(scored):
    assert scored.where("A > E + 1e-9 or E < 0 or E > 1 or V > 1 or G > 1 or R > 1").count() == 0
    assert scored.where("diagnosis_confidence < 0 or diagnosis_confidence > 1").count() == 0
    assert scored.where("(label = 'GOOD') != (diagnosis is null)").count() == 0


def test_score_of_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("1", None, None, None, None), ("2", "q 5", "", "", 5.0)], "id string, question string, trace string, gold_solution string, gold_answer double")
    got = {r.id: r for r in score(rows).collect()}
    assert got["1"].label == "BAD_WRONG" and got["1"].diagnosis == "NR" and got["1"].diagnosis_confidence == 1.0 and got["1"].G == 1.0
    assert score(rows.limit(0)).count() == 0


def greedy(m, offers):
    """Seeds one by one: fresh ones first, then the best again."""
    used, out = set(), []
    for sid, need, _ in offers:
        fresh = [r for r in range(m) if r not in used][:need]
        more = [r for r in range(m) if r in used and r not in fresh][: need - len(fresh)]
        out += [(sid, p, r) for p, r in enumerate(fresh + more)]
        used.update(fresh)
    return out


def test_allotment_equals_one_by_one(spark):
    rng = random.Random(1)
    words = {c: w[0] for c, w in CATEGORIES.items()}
    rows = [(i, f"{words[rng.choice(['ratio', 'time', 'rate'])]} " + "1 " * rng.randint(0, 9)) for i in range(70)]
    got = seeds.allotted(spark.createDataFrame(rows, "original_index int, question string"))
    sizes = {r.category_type: r["count"] for r in seeds.ranked(spark.createDataFrame(rows, "original_index int, question string")).groupBy("category_type").count().collect()}
    offers = seeds.offers(seeds.NEEDS, tuple(range(16)))
    assert [s for s, _, _ in offers[:4]] == [2, 13, 15, 3]
    for category, m in sizes.items():
        mine = sorted((r.strategy_id, r.pos, r["rank"]) for r in got.where(F.col("category_type") == category).collect())
        assert mine == sorted(greedy(m, offers))


def test_three_stage_skips_near_copies(spark):
    rows = [(0, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "a", 9), (2, [1.0, 0.01], "a", 8), (3, [0.6, 0.8], "b", 2), (4, [0.0, 1.0], "b", 1)]
    v = spark.createDataFrame(rows, "cand_id long, vec array<double>, category string, steps int").withColumn("pos", F.col("cand_id"))
    q = spark.createDataFrame([(100, [1.0, 0.0], "a")], "query_id long, vec array<double>, category string")
    assert [r.cand_id for r in retrieve.three_stage(q, v, 3).orderBy("place").collect()] == [1, 3, 4]
    assert [r.cand_id for r in retrieve.three_stage(q, v, 9).orderBy("place").collect()] == [0, 1, 2, 3, 4]


def test_blocks_of_candidates_give_the_same(spark, monkeypatch):
    v = registry.vectors(spark, SF)
    q, c = registry.query_vectors(v), registry.candidate_vectors(v)
    whole = sorted(map(tuple, retrieve.nearest(q, c, 5).select("query_id", "cand_id", "rank").collect()))
    monkeypatch.setattr(retrieve, "BROADCAST_BYTES", 60_000)
    assert retrieve.blocks_for(c) > 1
    assert sorted(map(tuple, retrieve.nearest(q, c, 5).select("query_id", "cand_id", "rank").collect())) == whole


def test_agreement_goldens(spark):
    rows = [(i, r) for i, rs in enumerate((["A", "B", "C", "A", "B"], ["A", "A", "B", "C", "C"], ["B", "C", "A", "A", "C"])) for r in rs] + [(9, "A")]
    got = stats.fleiss_kappa(spark.createDataFrame(rows, "item int, rating string")).first()
    counts = [[2, 2, 1], [2, 1, 2], [2, 1, 2]]
    observed = sum((sum(c * c for c in row) - 5) / 20 for row in counts) / 3
    expected = sum((sum(row[j] for row in counts) / 15) ** 2 for j in range(3))
    assert got.kappa == pytest.approx((observed - expected) / (1 - expected)) and got.n_items == 3
    alone = stats.fleiss_kappa(spark.createDataFrame([(1, "A"), (1, "A")], "item int, rating string")).first()
    assert alone.kappa != alone.kappa and alone.interpretation == "undefined"
    none = stats.cohen_kappa(spark.createDataFrame([(None, "A")], "a string, b string")).first()
    assert none.kappa != none.kappa and none.n == 0


def test_chi_square_of_one_category(spark):
    got = stats.chi_square(spark.createDataFrame([("x", "a", 3), ("x", "b", 4)], "r string, c string, n long")).first()
    assert tuple(got)[:5] == (0.0, 0, 1.0, 0.0, 0.0)


def test_final_outcomes_reset_and_order(spark):
    rows = [(1, "retry", "a", True, "GOOD", True, True), (2, "pass1", "a", True, "GOOD", None, None), (3, "pass1", "a", False, "BAD_WRONG", None, None), (4, "retry", "a", True, "GOOD", True, True), (5, "pass1", "b", False, "BAD_WRONG", None, None)]
    got = {r.id: r for r in aggregates.final_outcomes(spark.createDataFrame(rows, "line_no long, phase string, id string, correct boolean, label string, newly_correct boolean, became_good boolean")).collect()}
    assert (got["a"].pass1_correct, got["a"].recovered, got["a"].n_retries) == (False, True, 1) and not got["b"].final_correct


def test_prompts_and_turns(spark):
    example = F.struct(F.lit("e?").alias("question"), F.lit("t\n#### 1").alias("trace"))
    row = spark.range(1).select(F.lit("live?").alias("q"), F.array(example, example, example).alias("ex"), F.struct(F.lit("time").alias("category_type"), F.lit("simple").alias("complexity")).alias("cat"))
    for sid, plan in prompts.STRATEGIES.items():
        text = row.select(prompts.prompt(sid, F.col("q"), F.col("ex"), F.col("cat"))).first()[0]
        assert text.startswith(prompts.HEADER) and "Question: live?" in text and text.endswith(plan.cue)
    got = row.select(prompts.chat_turns(prompts.prompt(3, F.col("q"), F.col("ex"), F.col("cat")), F.lit("Do it."))).first()[0]
    assert [t.role for t in got] == ["system", "user", "assistant", "user", "assistant", "user", "assistant", "user"]
    assert got[0].content.endswith("\nDo it.") and got[-1].content == "live?" and got[2].content == "t\n#### 1"
    with pytest.raises(Exception, match="live question got lost"):
        row.select(prompts.chat_turns(F.lit("Question: \nSolution:"))).collect()
    with pytest.raises(ValueError):
        prompts.prompt(17, F.col("q"), F.col("ex"), F.col("cat"))


def test_retry_arms_show_equal_numbers(spark, scored):
    pool = scored.where("label = 'GOOD'").select("question", "trace", F.col("eval_index").alias("pos"))
    own = spark.createDataFrame([(f"How many is {i}?", f"{i} + 1 = {i + 1}\n#### {i + 1}", i) for i in range(20)], "question string, trace string, pos long")
    queue = scored.where("label != 'GOOD'").select("id", "question", "diagnosis")
    for arm in retry.ARMS:
        shown = retry.positives(pool, own, arm, 4)
        assert {r["count"] for r in shown.groupBy("ftype").count().collect()} == {4}
        out = retry.retry_prompts(queue, shown, arm)
        assert out.where("typed_positives != 4").count() == 0
        assert out.where("instr(prompt, extra_system) > 0 and extra_system != ''").count() == 0


def test_store_is_idempotent_and_streams(spark, scored, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    rows = attempts.attempts(spark, SF).where("eval_index < 60").drop("priority").withColumn("stored_at", F.current_timestamp())
    rows.write.json(str(folder))
    for k in range(2):
        scoring.score_into_store(scoring.arriving(spark, str(folder)), store, str(tmp_path / f"ck{k}")).awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == rows.count() == stored.select("bucket", "id").distinct().count()
    assert stored.where("bucket = 'pool' and label != 'GOOD'").count() == 0
    assert not set(route.SECRET) & set(route.exemplars(stored).columns)


def test_disjoint_seeds(spark):
    rows, own = spark.createDataFrame([("a",), ("b",)], "question string"), spark.createDataFrame([("b",)], "question string")
    assert [r.question for r in route.without_seeds(rows, own).collect()] == ["a"]
    with pytest.raises(Exception, match="seed in evaluation"):
        route.assert_disjoint(rows, own).collect()


def test_sources(spark, tmp_path):
    path = str(tmp_path / "rows.json")
    assert tables.read_lines(spark, path, "id string").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"id": "1"}\n{"id": "2"\n\n{"id": "1"}\n')
    assert [r.id for r in tables.done_ids(spark, str(tmp_path / "bad")).collect()] == ["1"]
    with pytest.raises(Exception):
        tables.read_lines(spark, str(tmp_path / "bad"), "id string").collect()
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({"quality_set": [{"id": "g1", "question": "q"}], "error_set": []}, indent=1))
    items = tables.golden_items(tables.read_document(spark, str(doc), tables.DOCUMENT), "quality_set")
    assert [r.id for r in items.collect()] == ["g1"]
    raw = spark.createDataFrame([(1, "q", "x\n#### 1,000"), (2, "q", "none"), (3, "q", "#### -4")], "eval_index int, question string, answer string")
    assert [r.gold_answer for r in tables.problems(raw, 2).orderBy("eval_index").collect()] == [1000.0, -4.0]
    tables.append_lines(raw, path)
    tables.append_lines(raw, path)
    assert tables.read_lines(spark, path, "eval_index int").count() == 6
    found = route.find_item(items, items.limit(0), "g1")
    assert found.first().section == "quality_set"
    with pytest.raises(LookupError):
        route.find_item(items, items.limit(0), "zz")


def test_reports(spark, scored):
    text = report.run_report(scored)
    assert text.startswith("# Run report") and "## Labels" in text
    summary = json.loads(tables.one_document(report.run_summary(scored)))
    assert summary["n_problems"] == scored.count()


def test_top_up_leaves_out_repeats(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, question string, pos int")
    b = spark.createDataFrame([(1, "y", 0), (1, "z", 1), (1, "w", 2)], "query_id int, question string, pos int")
    assert [r.question for r in retrieve.topped_up(a, b, k=3).orderBy("place").collect()] == ["x", "y", "z"]


def test_blocks_of_pairs_and_texts_change_nothing(spark, monkeypatch):
    """Small blocks and chunks give what one block gives; a vector that is null or has a null has no pair."""
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(50, "a", None), (51, "a", [1.0, None, 1.0, 1.0]), (52, None, [1.0] * 4), (53, "b", [1.0] * 3)]
    table = spark.createDataFrame(rows, "i long, g string, vec array<double>")
    want = {(r.g, r.i, r.j): r.cos for r in retrieve.pairwise(table, "g", "i").where("cos > 0.3").collect()}
    for most in (4096, 7):
        monkeypatch.setattr(retrieve, "VECTORS", most)
        got = {(r.g, r.i, r.j): r.cos for r in retrieve.similar_pairs(table, "g", "i", 0.3).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    words = ["red", "blue", "box", "car", "sun", "sea"]
    texts = [(i, " ".join(words[(i * j + j) % 6] for j in range(i % 5 + 1)), "xy"[i % 2] if i % 7 else None, i) for i in range(60)]
    pool = spark.createDataFrame(texts, "cand_id long, question string, category string, pos long")
    queries = pool.where("cand_id % 6 = 0").selectExpr("cand_id as query_id", "question", "category")
    index = retrieve.postings(pool, "cand_id", "question")
    found = []
    for block, chunk in ((16_384, 32_768), (9, 4)):
        monkeypatch.setattr(retrieve, "BLOCK", block)
        monkeypatch.setattr(retrieve, "CHUNK", chunk)
        best = retrieve.nearest_texts(queries, pool, index, 3)
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan
        found.append(sorted(tuple(r) for r in best.select("query_id", "rank", "cand_id", "score").collect()))
    assert found[0] == found[1] and len(found[0]) == 30


def test_outcomes_are_those_of_scores(spark):
    """The rows that need no R and G get the same label and type without them."""
    rows = attempts.attempts(spark, SF).where("eval_index % 7 = 0")
    light, whole = outcomes(rows), score(rows)
    assert not {"R", "G", "diagnosis_reason"} & set(light.columns)
    same = ["id", *RESTS_ON, "label", "diagnosis"]
    assert sorted(map(str, light.select(*same).collect())) == sorted(map(str, whole.select(*same).collect()))


def test_chat_turns_make_the_prompt_once(spark):
    plan = registry.QUERIES["chat_turns"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\nSolution: , coalesce(") == 1
