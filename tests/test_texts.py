import math
import re
import shutil

import pytest
from pyspark.sql import functions as F

from marlstone.operators import aggregates as A
from marlstone.operators import extract, retrieve
from marlstone.operators.route import new_records
from marlstone.params import DEFAULTS
from marlstone.plans import hard, registry
from marlstone.streaming import keyed

TEXTS = ["red apples and green pears", "red apples and red cherries", "", None, "green pears in the bowl", "the bowl of red apples", "a x y", "blue sky", "blue sky and red apples and green pears in the bowl", "red apples and green pears", "sky sky sky blue"]
QUERIES = ["red apples in the bowl", "blue blue sky", "nothing shared whatsoever", "", None, "and and and the"]


def terms(text, pairs):
    words = re.findall(r"\b\w\w+\b", (text or "").lower())
    return words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if pairs else [])


def fitted(texts, most, pairs):
    """Unit TF-IDF vectors of texts, fitted on them."""
    lists = [terms(t, pairs) for t in texts]
    total = {}
    for row in lists:
        for t in row:
            total[t] = total.get(t, 0) + 1
    kept = sorted(total, key=lambda t: (-total[t], t))[:most]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in row for row in lists))) + 1 for t in kept}
    out = []
    for row in lists:
        v = {t: row.count(t) * idf[t] for t in set(row) if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def dot(a, b):
    return sum(x * b.get(t, 0.0) for t, x in a.items())


def ranked(query, kind, pool, most, pairs):
    *vectors, own = fitted([t for _, t, _ in pool] + [query], most, pairs)
    scored = []
    for (pos, _, c), v in zip(pool, vectors):
        sim = round(dot(own, v), 9)
        scored.append((-(min(1.0, sim + 0.15) if c == kind else sim), pos, v))
    return sorted(scored, key=lambda x: x[:2])


@pytest.fixture(scope="module")
def frames(spark):
    pool = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)]
    candidates = spark.createDataFrame([(i, t, c, i, 1 + i % 4) for i, t, c in pool], "cand_id int, question string, category string, pos int, steps int")
    queries = spark.createDataFrame([(100 + i, q, "abc"[i % 3]) for i, q in enumerate(QUERIES)], "query_id int, question string, category string")
    return pool, candidates, queries


@pytest.mark.parametrize("most, pairs", [(512, True), (6, True), (3, True), (1, False), (None, False)])
def test_vectors_fitted_for_each_query(frames, most, pairs):
    pool, candidates, queries = frames
    index = retrieve.postings(candidates, "cand_id", "question", pairs)
    got = {}
    for r in retrieve.nearest_texts(queries, candidates, index, 4, most=most, pairs=pairs).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.cand_id, r.score))
    for i, q in enumerate(QUERIES):
        want = ranked(q, "abc"[i % 3], pool, most, pairs)[:4]
        assert [c for _, c, _ in sorted(got[100 + i])] == [pos for _, pos, _ in want], q
        assert [s for _, _, s in sorted(got[100 + i])] == pytest.approx([-s for s, _, _ in want], abs=1e-8)


def test_three_stages_fitted_for_each_query(frames):
    pool, candidates, queries = frames
    index = retrieve.postings(candidates, "cand_id", "question", False)
    got = {}
    for r in retrieve.three_stage_texts(queries, candidates, index, 3).collect():
        got.setdefault(r.query_id, []).append((r.place, r.cand_id))
    for i, q in enumerate(QUERIES):
        short = ranked(q, "abc"[i % 3], pool, None, False)[: max(DEFAULTS.shortlist, 3)]
        top = max(1 + pos % 4 for _, pos, _ in short)
        order = sorted(((-(DEFAULTS.w_relevance * -s + DEFAULTS.w_complexity * (1 + pos % 4) / top), rank, pos, v) for rank, (s, pos, v) in enumerate(short)), key=lambda x: x[:2])
        chosen = []
        for x in order:
            if len(chosen) < 3 and all(dot(x[3], y[3]) <= DEFAULTS.diversity_threshold for y in chosen):
                chosen.append(x)
        chosen += [x for x in order if all(x[2] != y[2] for y in chosen)]
        assert [c for _, c in sorted(got[100 + i])] == [x[2] for x in chosen[:3]], q


def test_an_index_of_deltas_is_the_index(spark, frames):
    _, candidates, queries = frames
    whole = retrieve.nearest_texts(queries, candidates, retrieve.postings(candidates, "cand_id", "question"), 3)
    halves = retrieve.postings(candidates.where("cand_id < 5"), "cand_id", "question").union(retrieve.postings(candidates.where("cand_id >= 5"), "cand_id", "question"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, retrieve.nearest_texts(queries, candidates, halves, 3).collect()))
    none = candidates.limit(0)
    assert retrieve.nearest_texts(queries, none, retrieve.postings(none, "cand_id", "question"), 3).count() == 0


# ------------------------------------------------------------ streams
def test_a_stream_appends_what_is_new(spark, tmp_path):
    kind = "bucket string, id string, eval_index long, trace string"
    store, checkpoint, arriving = str(tmp_path / "store"), str(tmp_path / "checkpoint"), tmp_path / "in"
    first = [("pool", "a", 2, "late"), ("pool", "a", 1, "early"), ("bad", "a", 1, "other bucket"), ("pool", None, 3, "no id")]
    second = [("pool", "a", 0, "too late"), ("pool", "b", 5, "new"), ("bad", "b", 6, None)]
    spark.createDataFrame(first, kind).coalesce(1).write.json(str(arriving / "one"))

    def run():
        rows = spark.readStream.schema(kind).option("recursiveFileLookup", "true").json(str(arriving))
        keyed.append_new(rows, store, checkpoint).awaitTermination()
        return sorted((str(r.bucket), str(r.id), r.trace) for r in spark.read.schema(kind).parquet(store).collect())

    want = sorted((str(r.bucket), str(r.id), r.trace) for r in new_records(spark.createDataFrame(first, kind), spark.createDataFrame([], kind)).collect())
    assert run() == want
    shutil.copytree(arriving / "one", arriving / "again")  # the same records once more, and a restart
    assert run() == want
    spark.createDataFrame(second, kind).coalesce(1).write.json(str(arriving / "two"))
    assert run() == sorted([*want, ("pool", "b", "new"), ("bad", "b", None)])


def test_a_stream_knows_first_solves(spark, tmp_path):
    kind, arriving = "id string, at long, correct boolean", tmp_path / "in"
    batches = [[("a", 2, True), ("a", 1, False), ("b", 1, None), ("a", 3, True)], [("a", 4, True), ("b", 2, True), ("c", 1, False)], [("b", 3, True), ("c", 2, True)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.json(str(arriving / str(i)))
    stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(arriving))
    got = keyed.drained(keyed.first_solves(stream, "at"), "solves-of-a-test")
    assert sorted((r.id, r.at) for r in got.where("newly_correct").collect()) == [("a", 2), ("b", 2), ("c", 2)] and got.count() == 9


# ------------------------------------------------------------ running sums
@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_running_sums_of_ranges_of_ranges(spark, buckets):
    rows = [(i * 3 - 50, i % 5 < 2, "xyz"[i % 3] if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "at long, correct boolean, kind string").repartition(5)
    for group in (None, "kind"):
        seen, solved, want = {}, {}, {}
        for at, ok, kind in rows:
            key = kind if group else None
            seen[key], solved[key] = seen.get(key, 0) + 1, solved.get(key, 0) + ok
            want[at] = seen[key], solved[key]
        assert {r["at"]: (r.seen, r.solved) for r in A.running_accuracy(df, "at", group, buckets).collect()} == want


# ------------------------------------------------------------ rows of texts
def test_rows_of_texts(spark):
    df = spark.createDataFrame([(1, "3 + 4 = 7\n2 * 2 = 5\n#### 7"), (2, None), (3, "no figures")], "id int, trace string")
    got = [(r.id, r.place, r.a, r.c, r.is_true) for r in extract.equation_rows(df, "trace", "id").orderBy("id", "place").collect()]
    assert got == [(1, 0, 7.0, 7.0, True), (1, 1, 4.0, 5.0, False)]
    assert [(r.id, r.step) for r in extract.step_rows(df, "trace", "id").orderBy("id", "place").collect()] == [(1, "3 + 4 = 7"), (1, "2 * 2 = 5"), (3, "no figures")]
    assert {r.value for r in extract.value_rows(df, "trace", "id").collect()} == {3.0, 4.0, 7.0, 2.0, 5.0}
    gold = spark.createDataFrame([(1, "<<2*3=6>>6 and <<x=y>>"), (2, None)], "id int, gold string")
    assert [(r.place, r.result, r.operands, r.ops) for r in extract.checkpoint_rows(gold, "gold", "id").collect()] == [(0, 6.0, [2.0, 3.0], ["*"])]


def test_lateral_joins_shuffle_nothing(spark):
    plan = extract.value_rows(hard.traces(spark, "/root/testdata/sf0.001"), "trace", "key", "line")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_no_text_is_read_twice_and_lines_are_dealt(spark):
    """An inferred filter must not repeat the parsing below, and one row group must not be one task."""
    made = registry.hard_traces(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (extract.equation_rows(made, "trace", "key", "line"), extract.step_rows(made, "trace", "key", "line")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "size(" in line and "transform(" in line]
