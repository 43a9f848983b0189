"""Session defaults and the one place that writes intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: Rows a driver-side list or a broadcast table may hold; larger inputs take a shuffle path.
BROADCAST_ROW_BOUND = 100_000

#: Pieces of driver code that start jobs at the same time, at most.
TOGETHER = 2

#: Bytecode of one generated method that HotSpot still compiles; Spark's own limit lets longer ones run interpreted.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", 8000)
_holders: dict[SparkSession, tuple[int, str]] = {}
_holders_lock = Lock()

#: Folders made by this process for sessions that name none (tests, single machines).
_own_folders: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "tabloom", memory: str = "16g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, else, on a single machine, one for this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folders.setdefault(app, "") or tempfile.mkdtemp(prefix="tabloom-")
        _own_folders[app] = folder
    return folder.rstrip("/")


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs started meanwhile do not fuse operators into methods that are too long to be compiled.

    The fused formulas of dozens of columns pass that length and then take about ten times as long. Holders may
    overlap; the session gets its own value back from the last one.
    """
    name, limit = METHOD_LIMIT
    with _holders_lock:
        n, own = _holders.get(spark, (0, spark.conf.get(name)))
        _holders[spark] = (n + 1, own)
        if int(own) > limit:
            spark.conf.set(name, limit)
    try:
        yield
    finally:
        with _holders_lock:
            n, own = _holders.pop(spark)
            if n > 1:
                _holders[spark] = (n - 1, own)
            else:
                spark.conf.set(name, own)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and computes the input once - which
    matters when recomputing it would not give the same rows again.
    """
    path = f"{shared_folder(df.sparkSession)}/tabloom/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has no more than ``bound`` rows, reading no further than needed."""
    return df.limit(bound + 1).count() <= bound


def together(steps: Sequence[Callable[[], DataFrame]]) -> list[Future]:
    """Run steps that start jobs of their own, up to ``TOGETHER`` of them at a time; all have ended on return."""
    with ThreadPoolExecutor(TOGETHER) as pool:
        return [pool.submit(step) for step in steps]
