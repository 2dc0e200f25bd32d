"""Session helpers: a tuned local session, and the folder that survives executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "pagewright", cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster, bring your own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` where the cluster names one. A temporary folder is made only
    where all runs on one machine; elsewhere a session without that setting is an error."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any file system that Spark knows."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Without complaint if it isn't there."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
