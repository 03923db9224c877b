import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "pii", "pack"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        assert kept[-1] <= kept[-2]
    assert kept[3] == kept[4]
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == kept[-1]
    assert docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0


def test_pipeline_of_odd_rows(spark, odd_documents):
    import corpus_pipeline

    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == odd_documents.columns
        assert docs.count() <= odd_documents.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() > 0


def test_run_matches_brute_force(spark):
    """The documents that come out, and their tokens, by brute force on what each stage got."""
    import corpus_pipeline
    import test_near_dup
    import test_rest

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    told = [(r.doc_id, r.text) for r in corpus_pipeline.identify_language(spark, docs, sf).collect()]
    first = {d for d, (_, c) in test_near_dup.brute(told, 5, 80).items() if c == d}
    left = [(d, t) for d, t in told if d in first]
    bad = {d for d, _ in test_rest.brute_overlaps(left, bench)}
    clean = {d: t for d, t in left if d not in bad}
    redacted = {r.doc_id: r.text for r in corpus_pipeline.redact_personal_data(spark, spark.createDataFrame(list(clean.items()), "doc_id long, text string"), sf).collect()}
    sizes = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert set(sizes) == set(clean) and len(clean) < len(told)
    assert all(sizes[d] == len(test_rest.ids_of(t)) for d, t in list(redacted.items())[:40])
