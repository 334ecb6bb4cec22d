"""Every query of the catalogue against its SQL in DuckDB, on the small test tables where they are."""

import os
from collections import Counter

import pytest

from weftline.plans.catalog import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF_DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(map(repr, r)) for r in rows.fetchall())
    assert Counter(tuple(repr(r[n]) for n in names) for r in df.collect()) == want


def test_entry_without_training_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def gone(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name="corpus_pipeline")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
