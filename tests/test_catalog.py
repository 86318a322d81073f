"""Every query of the catalog on the smallest tables, against the SQL registered with it."""

import datetime
import math

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v).removesuffix(" 00:00:00").removesuffix("+00:00")
    if isinstance(v, (int, str)):
        return str(v)
    return f"{float(v):.6g}".removesuffix(".0")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.SQL:
        found = duck.execute(catalog.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(names, found.fetchall())
        mine = rows(df.columns, got)
        assert len(mine) == len(want)
        assert [[x if x == y or not _near(x, y) else y for x, y in zip(a, b, strict=True)] for a, b in zip(mine, want, strict=True)] == [list(b) for b in want]
    else:
        assert got


def _near(x, y):
    try:
        return math.isclose(float(x), float(y), rel_tol=1e-5, abs_tol=1e-6)
    except ValueError:
        return False
