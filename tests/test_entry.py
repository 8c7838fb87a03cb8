"""The driver's contract, and every query with SQL against the SQL engine."""

import importlib
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from chunkweave import oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.abspath(entry.__file__))
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def test_names_agree():
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    out = queries.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    got = sorted((tuple(map(plain, r)) for r in out.select(*columns).collect()), key=repr)
    cur = con.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    for name in ("chunkweave", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{REPO}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/chunkweave/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("chunkweave") is not None
