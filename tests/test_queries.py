"""Every registered query with an oracle gives the oracle's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = _rows(df.select(*[f"`{c}`" for c in names]).collect())
    if name in registry.oracle_sql():
        found = duck.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        assert ours == _rows([[r[i] for i in order] for r in found.fetchall()])


def test_entry_points_without_the_corpus_folder(tmp_path):
    """The entry module imports where palimpsest/llm and corpus_pipeline.py are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "palimpsest"), tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'AG-01_count_by_group' in n and not any(k.startswith('op') for k in n) and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
