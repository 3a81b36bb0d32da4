"""Every registered query against its SQL on the smallest tables."""

import importlib.util

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sf, sql, name):
    df = registry.queries()[name](spark, sf)
    found = sql.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(r) for r in found.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["antecedent", "consequent", "support", "confidence"]
    assert set(registry.queries()) <= set(entry.queries())
    with_llm = importlib.util.find_spec("tidemark.llm") is not None
    assert any(q.startswith("op1_") for q in entry.queries()) == with_llm


def test_entry_without_training_data_operators(tmp_path):
    """The rest stands without that subpackage and its pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rules_slow' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
    if (root / "tidemark" / "llm").is_dir():  # without the pipeline alone, the operators stay
        shutil.copytree(root / "tidemark" / "llm", tmp_path / "tidemark" / "llm", ignore=shutil.ignore_patterns("__pycache__"))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op1_substring_dedup' in q"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
