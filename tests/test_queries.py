"""Every registered panel query against its oracle on the smallest tables; queries without one must run."""

import pytest

from tests.oracle import connect, same
from tidepanel.queries import registry


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


#: Heavier than a unit test should be; the driver runs them.
SLOW = {"walk_forward_ic"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, data, con, name):
    same(registry.QUERIES[name](spark, data), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_query_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).columns
    registry.QUERIES[name](spark, data).limit(5).collect()


def test_sinks_and_folds_take_the_whole_table(spark, data):
    from tidepanel.plans import views as v

    run = lambda name: registry.QUERIES[name](spark, data)
    assert run("publish_json").count() == v.bars_w(spark, data).count()
    assert sum(r["n_rows"] for r in run("repartition_layout").collect()) == v.bars_d(spark, data).count()
    assert sorted(r["fold"] for r in run("walk_forward_ic").collect()) == [0, 1, 2, 3, 4]


def test_no_oracle_proves_nothing():
    """On the tables that the driver compares, every oracle has rows and every column a value somewhere."""
    con = connect("/root/testdata/sf0.01")
    empty = {}
    for name, sql in registry.ORACLES.items():
        rows = con.sql(sql).df()
        nothing = [c for c in rows.columns if rows[c].isna().all()]
        if not len(rows) or nothing:
            empty[name] = nothing
    assert not empty
