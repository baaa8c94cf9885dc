"""Every query of the record operators against its SQL."""

import pytest

from millrace.plans import ORACLE, QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_equal(name, spark, sf, duck, rows_of):
    assert rows_of(QUERIES[name](spark, sf).toPandas()) == rows_of(duck.execute(ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_folder(tmp_path):
    """The entry points import and list the record operators when the optional parts are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))]
