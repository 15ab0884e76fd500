"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, app: str = "tableprobe") -> SparkSession:
    """A single-machine session for tests and the bench."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    It is the shared one the cluster names in ``spark.checkpoint.dir``. Only a session without
    any (a test on one machine) gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="tableprobe-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and continue from the files: small, and read by column."""
    place = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's own upper estimate of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SMALL_TABLE_BYTES = 2 * 1024**3


def spread(df: DataFrame) -> DataFrame:
    """Cache a small table over all cores when it comes in fewer pieces than there are cores.

    A profile scans its table a dozen times. One small file is read by one task each time;
    a table of any size worth a cluster already comes in many pieces and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if stored_bytes(df) > SMALL_TABLE_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores).persist()


def together(steps: dict[str, Callable[[], object]], at_once: int = 6) -> dict[str, object]:
    """Run independent Spark jobs at the same time from a few driver threads."""
    with ThreadPoolExecutor(max_workers=max(1, min(len(steps), at_once))) as pool:
        running = {name: pool.submit(inheritable_thread_target(step)) for name, step in steps.items()}
        return {name: job.result() for name, job in running.items()}
