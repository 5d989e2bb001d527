import math
import os

import duckdb
import pytest

from sightline.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    expected = sorted((tuple(plain(v) for _, v in sorted(zip(want.columns, row, strict=True))) for row in want.fetchall()), key=str)
    assert got == expected


def test_filters_reach_the_scan(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    plan = catalog.queries()["join_inner"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan


def test_shifted_bundle_next_to_the_limit(spark, db, tmp_path):
    """New times are cut to milliseconds; an event that lies past the limit by less than that stays, as in SQL."""
    hours = 21 * 24 * 3_600_000 + 7  # of the old range, in ms: 21 old ones become a new one
    offsets = sorted({0, hours, *(hours * (10 * k + 1) // 14_400 + d for k in range(0, 1440, 60) for d in range(-24, 48, 3) if 0 < hours * (10 * k + 1) // 14_400 + d < hours)})
    rows = ", ".join(f"({e}, {e % 5}, 'view', 1.0, TIMESTAMP '2024-01-01' + INTERVAL {t} MILLISECONDS)" for e, t in enumerate(offsets))
    c = duckdb.connect()
    c.sql(f"CREATE TABLE events AS SELECT CAST(e AS BIGINT) AS event_id, CAST(u AS BIGINT) AS user_id, k AS event_type, CAST(v AS DOUBLE) AS value, t AS ts FROM (VALUES {rows}) AS x(e, u, k, v, t)")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got = sorted(tuple(r) for r in catalog.queries()["shifted_bundle"](spark, str(tmp_path)).select("e", "minute").collect())
    assert got == sorted(c.sql(catalog.oracle_sql()["shifted_bundle"]).fetchall()) and len(got) < len(offsets)
