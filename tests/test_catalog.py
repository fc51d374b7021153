"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from sensorloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert got == want


def test_entry_works_without_the_corpus_subpackage(spark, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(catalog.__file__).resolve().parents[1]
    shutil.copytree(repo / "sensorloom", tmp_path / "sensorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kopt_composite' in q and not any(k.startswith('op') for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
