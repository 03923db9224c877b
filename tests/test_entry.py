import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ("fleiss_kappa", "cohen_kappa", "mcnemar_exact", "fisher_exact", "entropy_modal", "pass_at_k", "knn_topk", "retrieve_3stage", "seed_interleave", "clean_text", "question_features", "dedupe_append", "label_histogram")


def canon(rows, columns):
    def cell(x):
        return "null" if x is None else str(x) if isinstance(x, (bool, str)) else f"{float(x):.6f}"

    return sorted(tuple(cell(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canon([r.asDict() for r in got.collect()], columns) == canon([dict(zip(columns, r)) for r in want.fetchall()], columns)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('marlstone.llm'):\n"
        "            raise ModuleNotFoundError(name)\n"
        f"sys.meta_path.insert(0, No()); sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
