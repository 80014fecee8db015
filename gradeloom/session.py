"""Session settings and the shared folder for materialised steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gradeloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written steps: the one in ``spark.checkpoint.dir``.

    A temporary one is made only in local mode, where every task shares a disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="gradeloom-")
    elif folder.startswith("file:") and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must be shared by all executors, not a local folder")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """Path of a folder that does not exist yet, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/gradeloom-{uuid.uuid4().hex}"


#: Folders written so far by the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and continue from it.

    The lineage ends there, the rows are fixed, and the planner knows their
    size: joins broadcast the table only if its files are small enough. The
    innermost open scope of ``steps`` owns the table; without one it stays.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Own the tables that are written inside, and remove them at the end, also after an error.

    Write the result before the scope ends; frames that read the steps cannot
    be read after it. Scopes nest. What other threads write while a scope is
    open belongs to it as well.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        remove(spark, _SCOPES.pop())


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete written folders by the file system that they belong to."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_once(spark: SparkSession, make: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """The frame that ``make()`` returns, as a table; the steps made on the way are removed.

    The table is at ``path``, else in a new folder that the scope outside owns.
    """
    owned = path is None
    path = path or new_folder(spark)
    if _SCOPES and owned:
        _SCOPES[-1].append(path)
    with steps(spark):
        made = make()
        made.write.parquet(path)
        schema = made.schema
    return spark.read.schema(schema).parquet(path)
