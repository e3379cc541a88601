"""The driver's contract: every query against its SQL in another engine, and the library without the corpus subpackage."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as core
from tessera.plans.sql import SQL

ROOT = Path(__file__).resolve().parent.parent
TABLES = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables aren't here")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    df = core.QUERIES[name](spark, str(TABLES))
    got = plain([tuple(r) for r in df.collect()], df.columns)
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == plain(result.fetchall(), columns)
    assert got


@needs_tables
def test_flagship(spark):
    assert entry.entry(spark).columns == ["atom_id", "language"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_stands_without_the_corpus_subpackage(tmp_path):
    """Everything but tessera/llm, tests/llm and the pipeline, copied elsewhere, registers the other queries."""
    for p in [*ROOT.glob("*.py"), *(ROOT / "tessera").rglob("*.py")]:
        where = p.relative_to(ROOT)
        if "llm" not in where.parts and where.name != "corpus_pipeline.py":
            (tmp_path / where).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / where).write_text(p.read_text())
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    assert done.stdout.split() == sorted(core.QUERIES)
