"""SparkSession construction and shared runtime settings."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes (the
# broadcast threshold is checked against measured bytes, not guesses), splits
# skewed join partitions and coalesces small shuffle partitions.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # lists of keys of stored lookups reach the Parquet reader as such (Bloom
    # filters and page statistics), not as one range
    "spark.sql.parquet.pushdown.inFilterThreshold": "2000",
    # remove checkpoint files once their frame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "tidings",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system or object
    store); without it the job stops, because executors cannot read each
    other's local folders.  Only a ``local`` master, where driver and executor
    are one process, gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tidings-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written snapshots."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``tidings`` code usable in Python workers (``mapInPandas`` and
    pandas UDFs).  Functions of this package are pickled by value, so a
    worker needs no installed copy and nothing is staged on disk.  On a
    cluster where the package is installed (or passed with ``--py-files``)
    this is harmless."""
    import sys

    from pyspark import cloudpickle

    pkg = sys.modules[__name__.rsplit(".", 1)[0]]
    try:
        cloudpickle.register_pickle_by_value(pkg)
    except ValueError:  # already registered
        pass


_TABLES: list[str] = []  # written by cut_lineage and still there


def cut_lineage(df):
    """Cut the lineage of ``df`` by writing it as a Parquet table in the
    shared folder named by ``spark.checkpoint.dir`` and reading it back.

    One job (a reliable RDD checkpoint needs a persist and two), the plan is
    never recomputed downstream, and the files survive the loss of an
    executor.  Never a local checkpoint.  The files stay until the frames that
    read them are done with: ``scratch_tables`` around a job, or
    ``release_scratch``, deletes them, and so does the end of the driver."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that it names."""
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path names a folder in its file system."""
    jvm, sc = spark._jvm, spark.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _delete(paths: list[str]) -> None:
    from pyspark import SparkContext
    jvm = SparkContext._jvm
    if jvm is None:
        return
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active and active._jsc else jvm.org.apache.hadoop.conf.Configuration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release_scratch(since: int = 0) -> None:
    """Delete the tables that ``cut_lineage`` wrote (from number ``since``)."""
    gone = _TABLES[since:]
    del _TABLES[since:]
    _delete(gone)


@contextmanager
def scratch_tables():
    """Delete, at the end, the intermediate tables written inside: for jobs
    that end with their result written."""
    since = len(_TABLES)
    try:
        yield
    finally:
        release_scratch(since)


@atexit.register
def _at_exit() -> None:
    try:
        release_scratch()
    except Exception:  # the JVM may be gone already; nothing is left to tell
        pass
