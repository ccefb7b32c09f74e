"""The registered queries against their DuckDB SQL."""

import os

import pytest

from tessera.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda df: sorted(map(repr, df[cols].itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.mark.parametrize("lost", ["folders", "pipeline", "package"])
def test_entry_without_the_llm_folders(tmp_path, lost):
    """The entry imports, and the other queries are there, when the llm folders and the pipeline are gone, or one of
    them, or a package that they need."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    gone = ("llm", "__pycache__") if lost == "folders" else ("__pycache__",)
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns(*gone))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if lost == "package" and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
        (tmp_path / "xxhash.py").write_text("raise ModuleNotFoundError(name='xxhash')")
    code = "import __spark_entry__ as e; assert 'range_indexed' in e.queries() and not [q for q in e.queries() if q.startswith('op')] and 'range_indexed' in e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
