import os

import pytest

import __spark_entry__ as E
from lexiloom import catalog, oracle

DATA = "/root/testdata/sf0.001"

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def value(x):
    return round(x, 9) if isinstance(x, float) else x


@needs_data
def test_entry(spark):
    assert E.entry(spark).count() == 50


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df, sql = catalog.queries()[name](spark, DATA), con.sql(oracle.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    ours = sorted((tuple(map(value, r)) for r in df.select(columns).collect()), key=repr)
    theirs = sorted((tuple(map(value, r)) for r in sql.select(*columns).fetchall()), key=repr)
    assert ours == theirs


def test_only_a_missing_folder_is_left_out(tmp_path):
    """Without the optional folder the entry works; an import that fails within it is an error."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(any(q.startswith('p1_') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout == "False\n"
    (tmp_path / "lexiloom/llm").mkdir()
    (tmp_path / "lexiloom/llm/__init__.py").write_text("")
    for name in ("oracle", "queries"):
        (tmp_path / f"lexiloom/llm/{name}.py").write_text("import no_such_module_at_all")
    assert "no_such_module_at_all" in run().stderr
