"""Every query of the base library against its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import pytest

from papyra.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = sorted((tuple(map(plain, r)) for r in out.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    con = duck.execute(ORACLES[name])
    names = [d[0] for d in con.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[i]) for i in order) for r in con.fetchall()), key=repr)
    assert got == want


def test_entry_module():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_whole_tables_are_asked(spark, duck):
    days = duck.execute("SELECT count(DISTINCT (user_id, CAST(ts AS DATE))) FROM events").fetchone()[0]
    assert QUERIES["worst_parse_by_day"](spark, FOLDER).count() == days
    ids = {r[0] for r in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    assert {r["query_id"] for r in QUERIES["vector_topk_share"](spark, FOLDER).collect()} == ids
