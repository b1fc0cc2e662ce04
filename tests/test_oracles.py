"""Every query of the engine against its SQL on the smallest tables."""

import os

import pytest

from stratamix.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    cells = lambda v: None if v is None or v != v else v if isinstance(v, str) else round(float(v), 6) + 0.0
    return sorted((tuple(cells(v) for v in r) for r in df[sorted(df.columns)].values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLES[name]).df())


def test_entry_works_without_the_training_data_operators(tmp_path):
    """On a copy without the operators, their tests and the pipeline: the entry imports and has the rest."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    shutil.copytree(here, tmp_path / "repo", ignore=lambda _, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse")])
    code = "import __spark_entry__ as e, stratamix.plans.model, stratamix.streaming.score; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""}, check=True)
    assert out.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES)), "0"]
