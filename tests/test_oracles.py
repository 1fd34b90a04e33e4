"""Every registered query of the engine against its SQL twin in DuckDB."""

import math
import os
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest

from vitalframe import catalog

from .conftest import DATA, ROOT

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = db.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert have == want


def test_flagship_profiles_every_flat_table(spark, db):
    have = {(r["object"], r["path"]) for r in catalog.QUERIES["profile_fields_all"](spark, SF).select("object", "path").collect()}
    assert have == {(t, c) for t in catalog.FLAT for c in db.sql(f"SELECT * FROM {t} LIMIT 0").columns}


def test_flagship(spark):
    metrics = {(r["metric"], r["object"], r["path"]): r["value"] for r in catalog.QUERIES["analyze_all"](spark, SF).collect()}
    assert metrics["row_count", "nation", ""] == 25 and 0 < metrics["health", "", ""] <= 100


def test_analysis_of_all_tables(spark, db):
    """Every table that is there is analysed, and every row of it is counted."""
    metrics = {(r["metric"], r["object"], r["path"]): r["value"] for r in catalog.QUERIES["analyze_all"](spark, SF).collect()}
    tables = [f.removesuffix(".parquet") for f in os.listdir(SF)]
    assert {o: v for (m, o, _), v in metrics.items() if m == "row_count"} == {t: db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in tables}
    have = {(o, p) for m, o, p in metrics if m == "coverage" and "[]" not in p}
    assert have == {(t, c) for t in tables for c in db.sql(f"SELECT * FROM {t} LIMIT 0").columns}


def test_entry_without_the_optional_part():
    """The entry point works where the training-corpus operators are absent."""
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline',) or name.startswith('vitalframe.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
