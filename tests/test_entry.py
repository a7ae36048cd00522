"""Every query of the catalog against its twin in another engine, and the entry module without the optional parts."""

from __future__ import annotations

import glob
import importlib
import math
import os
import sys

import pytest

from spanloom.plans import catalog, ingest, upkeep  # noqa: F401  (their queries join the catalog's)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, str)) else v


@pytest.mark.parametrize("name", catalog.SQL)
def test_twin(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    key = lambda r: [(v is None, str(v)) for v in r]
    want = sorted(([_plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=key)
    assert sorted(([_plain(r[c]) for c in columns] for r in df.collect()), key=key) == want


def test_every_query_has_a_twin():
    assert set(catalog.SQL) == set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_optional_parts(monkeypatch):
    import __spark_entry__

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "spanloom.llm" or name.startswith("spanloom.llm.") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n.startswith("spanloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.SQL)
