"""Session settings, table access and the checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC and adaptive execution.

    ``master`` stays unset on a cluster, where spark-submit names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, app: str = "millrace-local") -> SparkSession:
    """Single-machine session for tests and the bench."""
    spark = build_session(
        app,
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local one only when none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders of written tables that this process has named, and has not removed yet.
WORK: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, below the checkpoint folder so all executors see it.

    It lasts until ``clear_work`` or the end of the process.
    """
    if not WORK:
        atexit.register(_at_end, spark)
    WORK.append(f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return WORK[-1]


def clear_work(spark: SparkSession) -> int:
    """Remove the written tables of this process; returns how many there were. Frames that read them are gone with them."""
    conf, removed = spark._jsc.hadoopConfiguration(), 0
    while WORK:
        path = spark._jvm.org.apache.hadoop.fs.Path(WORK.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def _at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone before
        if spark.sparkContext._jsc is not None:
            clear_work(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back, so what reads it does not run it again."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables whose rows cost much computing per byte read.
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Give a text table at least one partition per core.

    A table smaller than cores x split size is read in fewer tasks than there are cores, and text work is
    bound by computing. Its bytes are known to be few, so one shuffle is cheap. A large table already has
    more splits than cores and is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


class Tables:
    """Attribute access to the Parquet tables below one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(self.path(name))
        return spread(df) if name in TEXT_TABLES else df
