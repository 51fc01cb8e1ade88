"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "heatscape", cores: int | None = None) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    n = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.default.parallelism", str(n))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _set_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and sc.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="heatscape-checkpoint-")
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(shared)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a column depends on physical placement (partition number, row
    position) and must not change when a lost executor's work is redone.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name next to the checkpoints, which every executor can reach."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        _set_checkpoint_dir(spark)
    return f"{sc.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_heatscape_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="heatscape-code-"), "heatscape"), "zip",
                                  os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(archive)
    sc._heatscape_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input that has fewer partitions than there are cores, over all cores.

    A table of many files is left as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def side_by_side(spark: SparkSession, calls: list, threads: int = 4) -> list:
    """Results of independent calls, several of which submit their Spark jobs at a time."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda call: call()), calls))
