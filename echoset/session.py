"""Session helpers: a local session for tests/bench and the checkpoint folder.

On a cluster the session is built by the caller; the engine only reads
``spark.checkpoint.dir`` from it. A private folder is created only when the
setting is absent *and* the master is local (tests, bench).
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "echoset") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on, UTC)."""
    builder = SparkSession.builder
    if os.environ.get("ECHOSET_EVENT_LOG"):  # profiling: stage times without the UI
        builder = builder.config("spark.eventLog.enabled", "true").config(
            "spark.eventLog.dir", "file://" + os.environ["ECHOSET_EVENT_LOG"])
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ECHOSET_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def spread(df):
    """Give row-local CPU work (parsing, hashing) every core.

    A repartition only when the input has fewer partitions than the cluster
    has task slots — small inputs stored as one file/row group. Large inputs
    already have many splits, so at scale this is a no-op and adds no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``echoset`` importable in Python workers (``addPyFile`` of a zip).

    Same as ``--py-files`` on spark-submit; done once per SparkContext.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="echoset-pkg-", dir="/tmp")
    zpath = os.path.join(out_dir, "echoset.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir``. Only when it is unset and the master is
    local is a fresh scratch folder created (test/bench use). On a cluster an
    unset value is an error: a machine-local folder would not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so iterative jobs can cut their lineage"
        )
    scratch = tempfile.mkdtemp(prefix="echoset-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


class Scratch:
    """Tables kept in a folder of the checkpoint folder while a job reads them again and again.

    Compressed and read by column, unlike Spark's checkpoints, whose rows are as large as in memory. The folder is
    dropped at the end of the ``with`` block, so what leaves the block must not read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df):
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, n: int) -> None:
        """Drops the ``n``-th table kept."""
        drop_folder(self.spark, f"{self.folder}/{n}")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        drop_folder(self.spark, self.folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Spark drops shuffle and checkpoint files when it sees that nothing refers to them: lets it look now, not at some later time.

    Twice, as what the last job's listeners and finalizers hold is free at the second look only.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)
