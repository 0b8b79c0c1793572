"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessel") -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join
    partitions, and turns a sort-merge join into a broadcast join only after
    it has *measured* the build side at run time.
    """
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # remove checkpoint files once their DataFrame is garbage-collected
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # big documents: keep Arrow batches small enough for a 15 M-char text
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
         .config("spark.driver.memory", os.environ.get("TESSEL_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is read, never
    overridden. Only when it is unset *and* the master is local (tests, the
    bench) do we create a scratch folder of our own.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tessel-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"


def materialize(df):
    """Cut a long or widely reused lineage: a reliable checkpoint into the
    shared ``spark.checkpoint.dir`` (survives executor loss, unlike a local
    checkpoint). Downstream plans — and the scalar subqueries inside them —
    then start from the written data instead of re-deriving it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str, **options):
    """A large table that is read several times, as compressed columns in the shared scratch folder: a checkpoint
    holds whole rows uncompressed. ``options`` are those of the Parquet writer."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df, key: str):
    """On a local master, deal a table of fewer files than threads over all threads by
    ``key`` (a file of one row group is one split). On a cluster the scan is left as it
    is, whatever its size: texts are not shuffled to gain parallelism."""
    sc = df.sparkSession.sparkContext
    if not sc.master.startswith("local[") or len(df.inputFiles()) >= sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism, key)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessel`` importable in Python workers (pickled UDFs refer to it by
    module): zip the package once per application and ``addPyFile`` it, which
    distributes it to every executor."""
    import shutil
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="tessel-pkg-", dir="/tmp")
    archive = shutil.make_archive(os.path.join(out, "tessel"), "zip", os.path.dirname(pkg), "tessel")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
