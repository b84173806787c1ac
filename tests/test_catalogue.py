import duckdb
import pytest

from rebill.plans import catalogue, subscriptions

D = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def shared_frames(spark):
    """Queries of this module share the cached groups and subscriptions instead of planning them anew each time."""
    whole = {name: getattr(subscriptions, name) for name in ("_vocab", "_keys", "_fine", "_subs")}
    for name, build in whole.items():
        kept = build(spark, D).cache()
        setattr(subscriptions, name, lambda s, d, kept=kept: kept)
    yield
    for name, build in whole.items():
        setattr(subscriptions, name, build)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS FROM '{D}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})")
    want = con.fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, want))
    assert want
