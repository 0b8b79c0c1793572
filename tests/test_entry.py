"""Driver contract: entry runs, every query has a callable, oracle keys are a subset."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"label", "precision", "recall", "f1", "support"}
    assert df.count() >= 3


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 130 and len(o) >= 120


def test_some_queries_small(spark):
    q = E.queries()
    for name in ("prepare_view", "alpha_quotas", "actor_resolution", "tei_roundtrip"):
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
