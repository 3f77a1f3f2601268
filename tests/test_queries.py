"""Every registered query with SQL gives DuckDB's rows."""

import os
from pathlib import Path

import duckdb
import pytest

from wayfold.plans.registry import QUERIES, SQL, flagship

DATA = "/root/testdata/sf0.001"


def rows(df):
    def cell(v):
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    cols = sorted(df.columns)
    d = df[cols].astype(object)
    return sorted(str(tuple(float(c) if isinstance(c := cell(v), int) and not isinstance(c, bool) else c for v in r)) for r in d.where(d.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(SQL[name]).df())


def test_flagship(spark):
    got = flagship(spark, DATA).collect()
    assert len(got) == 10
    for r in got:
        assert r.status in {"ok", "invalid-place", "unreachable"}


def test_entry_without_training_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['wayfold.llm'] = None; import __spark_entry__ as e; assert 'arcs' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], env=os.environ).returncode == 0
