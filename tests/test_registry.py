"""Every registered query of the library runs on the smallest tables; those with SQL equal it."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from oreflow.plans import registry

#: Their SQL knows the hash parameters for more than 500 items only.
MINHASH = {"minhash_lsh_pairs", "minhash_signature", "user_cf_model", "user_cf_predict"}
SLOW = {"girvan_newman", "bfr_rounds", "bfr_membership", "edge_betweenness", "modularity", "connected_components"}


def frame(x):
    x = x[sorted(x.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in x.itertuples(index=False))


def connected(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - SLOW))
def test_query_equals_its_sql(spark, tiny, name):
    folder = tiny.replace("sf0.001", "sf0.01") if name in MINHASH else tiny
    got = registry.QUERIES[name](spark, folder).toPandas()
    want = connected(folder).sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got) == frame(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE) - SLOW))
def test_query_without_sql_runs(spark, tiny, name):
    assert registry.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark, tiny):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_subpackage(tmp_path):
    """A copy from which the corpus subpackage and its tests are deleted still lists the library's queries."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    leave = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(root, copy, ignore=leave)
        if not keep_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
        assert said.returncode == 0, said.stderr
        assert said.stdout.strip() == str(sorted(registry.QUERIES))
