"""Every query with SQL against DuckDB, and the driver's entry."""

import pytest

from recordloom import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, duck, same_rows):
    same_rows(queries.queries()[name](spark, sf), duck.sql(SQL[name]))


def test_all_queries_have_sql():
    assert set(SQL) == set(queries.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_llm(tmp_path):
    """The rest must import when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).parent.parent
    shutil.copytree(repo / "recordloom", tmp_path / "recordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(queries.queries())
