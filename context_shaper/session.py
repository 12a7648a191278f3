"""Session defaults for stand-alone runs, and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Files that one table is read from, where it is up to the code: the driver holds some kilobytes for each while it is read.
FILES_A_LOT = 20_000

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING_CACHE_KEY = "spark.sql.hive.filesourcePartitionFileCacheSize"
_LISTING_TASKS_A_CORE = 4
_OPEN_COST_KEY = "spark.sql.files.openCostInBytes"
_OPEN_COST_BYTES = 64 << 10
_own_folders: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("context-shaper")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a session whose executors live in the driver's process (a local master) may go without
    one and gets a private folder, removed when the process ends.  Elsewhere a missing setting
    is an error: files on an executor's own disk would be invisible to the others.
    """
    folder = spark.conf.get(_CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors of {master} share")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="context-shaper-")
        atexit.register(shutil.rmtree, _own_folders[application], ignore_errors=True)
    return _own_folders[application]


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/context_shaper/{spark.sparkContext.applicationId}"


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged; results not yet written out need it."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(_application_folder(spark))
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several consumers need one expensive narrow table: the text is scanned once,
    later passes read only the columns they need, and the lost-executor recovery of those
    passes starts from files instead of from the text.  Knowing the file size also lets the
    planner choose between a broadcast and a shuffle join.
    """
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_more(df: DataFrame, path: str) -> DataFrame:
    """Add rows to a table that is staged part by part, and read back all that is there."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Tables loaded inside list their paths in a few tasks a core, whatever the number of paths.

    By default each of the first 10,000 paths is a task of its own, whose start takes longer than its listing.
    What was listed goes with the table; by default the driver keeps it, up to 250 MB.
    """
    tasks = min(int(spark.conf.get(_LISTING_KEY, None) or 10_000), _LISTING_TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    with _conf(spark, {_LISTING_KEY: str(tasks), _LISTING_CACHE_KEY: "0"}):
        yield


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Tables of many small files that are computed inside are read by fewer tasks.

    By default a file counts as four megabytes at least, so a few files are a task; the driver keeps
    kilobytes of each task, and of past ones.
    """
    with _conf(spark, {_OPEN_COST_KEY: str(_OPEN_COST_BYTES)}):
        yield
