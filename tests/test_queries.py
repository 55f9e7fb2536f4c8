import ast
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import ORACLES, QUERIES

ROOT = Path(__file__).parent.parent
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return (x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, abs_tol=2e-6, rel_tol=1e-9))
    return x == y


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    cols = sorted(rel.columns)
    assert sorted(got.columns) == cols
    key = lambda r: tuple((x is None, round(x, 4) if isinstance(x, float) else x) for x in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    b = sorted((tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in at) for r in rel.fetchall()), key=key)
    assert len(a) == len(b) and all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"token", "next_token", "n", "p_next", "pmi"}
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] + [a.name for a in node.names] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), p
