"""The driver's contract: queries against their SQL, the entry, and life without the optional folder."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E
from trawl.plans import registry

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, name):
    df = E.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    rel = con.sql(registry.ORACLE_SQL[name])
    order = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(same(r[i]) for i in order) for r in rel.fetchall()), key=repr)


@needs_data
def test_entry(spark):
    assert 0 < E.entry(spark).count() <= 10


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_queries_without_the_optional_folder(tmp_path, pipeline_left):
    shutil.copytree(f"{REPO}/trawl", tmp_path / "trawl", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    if pipeline_left and os.path.exists(f"{REPO}/corpus_pipeline.py"):
        shutil.copy(f"{REPO}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
