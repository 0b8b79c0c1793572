import random

import duckdb
from pyspark.sql import functions as F

from tessel.llm import mixing as X

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, budget int"


def rows_of(seed, n=300):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append((i, " ".join(["w"] * r.choice([0, 1, 3, 10, 60])), r.choice(["en", "en", "en", "de", "fr", None, "xx"]), r.choice(["src0"] * 6 + ["src1", "src2", "s9", None])))
    return out + [(i, t, g, s) for i, t, g, s in out[:5]] + [(None, "a b c", "en", "src0"), (None, "a b c", "en", "src0"), (900, None, "en", "src0"),
                                                           (901, "w " * 30_000, "de", "big"), (902, "", "only", "empty")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, X.decide(df, **kw).drop("doc", "h").collect()), key=str)


def in_sql(rows, **kw):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(X.sql(**kw)).fetchall(), key=str)


def test_same_as_sql(spark):
    rows = rows_of(1)
    for kw in ({}, {"budget_percent": 500, "max_epochs": 3}, {"budget_percent": 7, "weights": {"lang": {"en": 0, "de": 9}, "source": {"src1": 0}}}):
        assert run(spark, rows, **kw) == in_sql(rows, **kw)
    assert run(spark, []) == []


def fill(budget, nodes):
    """Plain water filling: nodes of (cap, weight)."""
    share, live = [0.0] * len(nodes), [i for i, (c, w) in enumerate(nodes) if w > 0]
    while budget > 1e-9 and live:
        total = sum(nodes[i][1] for i in live)
        full = [i for i in live if nodes[i][0] - share[i] <= budget * nodes[i][1] / total]
        if not full:
            for i in live:
                share[i] += budget * nodes[i][1] / total
            break
        for i in full:
            budget -= nodes[i][0] - share[i]
            share[i] = nodes[i][0]
        live = [i for i in live if i not in full]
    return share


def test_shares_are_water_filling(spark):
    r = random.Random(5)
    for _ in range(3):
        nodes = [(r.choice([0, 5, 40, 300, 1000]), r.choice([0, 1, 2, 7])) for _ in range(9)]
        cap = sum(c for c, w in nodes if w)
        budget = r.randint(0, cap)
        df = spark.createDataFrame([(0, f"n{i}", c if w else 0, w, budget) for i, (c, w) in enumerate(nodes)], "root int, name string, cap long, weight long, budget long")
        got = {x.name: x.share for x in X.deal(df, ["root"], "name").collect()}
        want = fill(budget, nodes)
        assert sum(got.values()) == budget and all(abs(got[f"n{i}"] - want[i]) <= 1 for i in range(9))


def test_mixed_rows_follow_the_copies(spark):
    rows = rows_of(2)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    copies = X.decide(df).groupBy("doc_id", "tokens").agg(F.sum("copies").alias("c")).where("doc_id is not null").collect()
    out = X.mixed(df)
    assert out.columns == df.columns
    n = {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()}
    times = {}
    for i, t, g, s in set(rows):
        times[i] = rows.count((i, t, g, s))
    assert all(n.get(x.doc_id, 0) == x.c * times[x.doc_id] for x in copies)
    # budgets are kept: no leaf goes beyond its share, the whole stays within the budget
    spent = X.decide(df).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    total = X.decide(df).agg(F.sum("tokens")).first()[0]
    assert 0.2 * total < spent <= 0.75 * total  # the 30,000-word text fits no rest
