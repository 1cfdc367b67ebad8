"""Session defaults, shared scratch tables and size-checked collects."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a failing read or write raises: the second for plain Java I/O errors.
SPARK_ERRORS = (PySparkException, Py4JJavaError)

# Rows a parameter list (vocabulary, topics, word lists) may have to be inlined
# as literals. Longer lists stay tables and are joined.
INLINE_LIMIT = 10_000

_RUN: ContextVar[str] = ContextVar("run", default="")   # sub-folder of the current scratch


def build_session(app: str = "voxtally", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``shuffle_partitions`` is the upper bound from which AQE coalesces: about
    one per 128 MB of shuffled data on a cluster, one per core locally.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # long expressions are built faster without a call site per column
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its
    own; on a cluster a missing setting is an error, since a machine-local
    folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache(maxsize=None)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="voxtally-")


def stage(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    ``by`` names columns to lay the files out by, for readers of single values.

    Cuts lineage, survives lost executors, and gives the optimizer the real
    table size: a later join broadcasts the table only while it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_RUN.get()}{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Staged tables made inside are deleted at the end: use their results before.

    Without it they stay under ``<shared folder>/<application id>/``.
    """
    outer = _RUN.get()
    _RUN.set(f"{outer}run-{uuid.uuid4().hex}/")
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{_RUN.get()}"
    try:
        yield
    finally:
        _RUN.set(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_rows(df: DataFrame, limit: int = INLINE_LIMIT) -> list | None:
    """All rows of ``df`` when there are at most ``limit`` of them, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_table(spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType) -> DataFrame:
    """A table from rows the caller already holds.

    It becomes a local relation of known size, so that joins with it need no
    Python worker and no hint.
    """
    arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of an input with fewer splits than cores over all cores.

    A large input has more splits than cores and is returned as it is, so no
    shuffle is added at scale. A few partitions per core even out long texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(4 * cores, *[F.col(k) for k in keys])
