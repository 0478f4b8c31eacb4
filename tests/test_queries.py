"""Every registered curation and evaluation query against its SQL, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("SHARDLOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from shardloom.plans import curation, evaluation  # noqa: E402, F401
from shardloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall()), key=repr)
