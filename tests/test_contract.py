import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_optional_parts(tmp_path):
    """A copy without them imports and registers the rest."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    n, m, some = told.stdout.split()
    assert int(n) > 45 and int(m) > 38 and some == "False", told.stderr


@pytest.mark.parametrize("name", ["page_sequence", "merge_document", "request_cost", "table_row_widths"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "part", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    own = entry.queries()[name](spark, SF)
    told = con.sql(entry.oracle_sql()[name])
    assert sorted(own.columns) == sorted(told.columns)
    columns = sorted(own.columns)
    assert sorted((tuple(r[c] for c in columns) for r in own.collect()), key=repr) == sorted((tuple(r) for r in told.select(*columns).fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["category", "doc_id", "n_errors", "n_warnings", "level"]
