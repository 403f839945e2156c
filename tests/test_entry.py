"""The entry module: its queries, and that the rest stands without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_entry_stands_without_the_training_data_folders(tmp_path):
    for name in ("__spark_entry__.py", "lexspark"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)  # what it imports is gone, as after a partial deletion
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="no tables")
def test_core_queries_agree_with_their_sql(spark):
    """Column names and rows of every core query, against DuckDB on the smallest tables."""
    from lexspark import plans

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    wrong = []
    for name, sql in plans.ORACLES.items():
        got = plans.QUERIES[name](spark, str(SMALL)).toPandas()
        want = con.execute(sql).df()
        columns = sorted(want.columns)
        rows = lambda df: sorted(map(_plain, df[columns].itertuples(index=False)), key=repr)  # noqa: B023, E731
        if sorted(got.columns) != columns or rows(got) != rows(want):
            wrong.append(name)
    assert not wrong


def _plain(row) -> tuple:
    def one(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, dict):
            return tuple((k, one(v)) for k, v in x.items())
        if hasattr(x, "asDict"):
            return one(x.asDict())
        if isinstance(x, list | tuple):
            return tuple(map(one, x))
        if x is None or x is pd.NA or x != x:
            return None
        return round(float(x), 6) if isinstance(x, float | int) and not isinstance(x, bool) else str(x)

    return tuple(map(one, row))
