"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "16g", app: str = "strandline") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(input_bytes: int, executor_cores: int) -> dict[str, str]:
    """Session settings for an input of the given size, to be passed to ``spark.conf.set``.

    Shuffles start with a partition for each GB of input (what is shuffled is
    smaller) and at least three per core, and adaptive execution merges the small
    ones; the default of 200 partitions would mean hundreds of GB in each for 100 TB.
    """
    partitions = max(3 * executor_cores, -(-input_bytes // 2**30))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.session.timeZone": "UTC",
    }


_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
#: The tables staged in the scope around the running code; threads have their own.
_scope: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session whose tasks all run in the driver may go without the setting; it
    gets a folder of its own, which goes with the process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="strandline-", ignore_cleanup_errors=True)
    return _local_folders[context.applicationId].name


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table, in the application's part of the shared folder.

    What no ``staging`` scope deletes can go with that one folder once the application has ended.
    """
    return f"{shared_folder(spark)}/strandline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once, with Spark's ``options`` of a writer, and continue from the written table.

    Used where a result is read several times (a fit and its transform). The
    table outlives lost executors, which a cache does not. It stays until it is
    released, or until the ``staging`` scope around it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.staged_path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what is staged inside when the scope ends; results must have been written by then.

    Gives the paths staged so far. A scope holds what its own code stages: scopes in
    other threads, and inner scopes, have lists of their own.
    """
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)
        for path in paths:
            _remove(spark, path)


def in_thread(spark: SparkSession, fn: Callable) -> Callable:
    """``fn`` for one call in another thread, in the scope and with a copy of the local properties of this one.

    What is wrapped once hands the same properties to all its calls. Calls at the same
    time would then see each other's SQL executions begin and end, and fail.
    """
    context, run = copy_context(), inheritable_thread_target(spark)(fn)
    return lambda *args: context.run(run, *args)


def in_parallel(spark: SparkSession, fn: Callable, items: Iterable, threads: int) -> list:
    """``fn`` of each item, a few at a time; what they stage belongs to the scope around the call."""
    jobs = [(in_thread(spark, fn), item) for item in items]
    with ThreadPool(threads) as pool:
        return pool.starmap(lambda run, item: run(item), jobs, chunksize=1)


_shared: dict[tuple, object] = {}
_sharing = threading.RLock()


def once_per_session(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], object]) -> object:
    """What ``make`` returns, made once for these input files and kept until the application ends.

    The tables it stages outlive any scope. Inputs that have changed since (in length
    or time of change, file by file) are a new key, and so are made again.
    """
    state = []
    for path in inputs:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
        state.append((path, tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))))
    key = (spark.sparkContext.applicationId, name, tuple(state))
    with _sharing:
        if key not in _shared:
            token = _scope.set(None)
            try:
                _shared[key] = make()
            finally:
                _scope.reset(token)
        return _shared[key]
