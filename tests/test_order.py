"""Running document numbers, first rows in order and exact shards."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.plans.rank import first_n, row_numbers
from tessel.session import scratch_path
from tessel.sources import tei as TEI
from tessel.sources import tsv as TSV


def corpus(spark, name, files, first):
    """Files of some documents each; every other one has no id."""
    path, k, text = scratch_path(spark, f"order-{name}-{random.random()}"), first, []
    for f, n in enumerate(files):
        docs = []
        for _ in range(n):
            ident = f' xml:id="x{k}"' if k % 2 else ""
            docs.append(f"<TEI{ident}><text><body><p>text {k} {'y' * (k % 7 * 40)}</p></body></text></TEI>")
            text.append(f"text {k}")
            k += 1
        body = "<?xml version='1.0'?>\n<teiCorpus>" + "\n".join(docs) + "</teiCorpus>\n"
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/part-{f:03d}.xml")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(body.encode()))
        out.close()
    return path, k


@pytest.mark.parametrize("split", ["134217728", "1000", "300"])
def test_ordinals_do_not_depend_on_splits(spark, split):
    one, k = corpus(spark, "a", [7, 1, 30], 1)
    two, k = corpus(spark, "b", [12, 0, 9], k)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = TEI.scan_in_order(spark, [(one, "a", None), (two, "b", "web")]).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sorted((r.ordinal, r.id, r.text.split()[1], r.corpus_id) for r in got) == [
        (i, f"x{i}" if i % 2 else f"doc_{i}", str(i), "a" if i <= 38 else "b") for i in range(1, k)]


def test_row_numbers_and_first_rows(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    got = row_numbers(df, [F.desc("v"), "id"]).orderBy("row_no").collect()
    assert [(x.id, x.v) for x in got] == sorted(rows, key=lambda x: (-x[1], x[0])) and [x.row_no for x in got] == list(range(500))
    assert {x.id for x in first_n(df, 33, ["v", "id"], "id").collect()} == {i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))[:33]}
    assert row_numbers(df.limit(0), ["id"]).count() == 0


def test_exact_shards(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(105)], "id long, text string").repartition(4)
    path = TSV.write_exact_shards(df, scratch_path(spark, f"exact-{random.random()}"), 10, "id", ["id"])
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("f")).collect()
    for k in range(11):
        mine = [r for r in back if r.shard == f"train_{k:03d}"]
        assert sorted(r.id for r in mine) == list(range(10 * k, min(105, 10 * k + 10))) and len({r.f for r in mine}) == 1
