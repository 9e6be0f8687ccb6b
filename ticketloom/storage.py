"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Tables written by this process and not yet deleted, each with what deletes it, also when its session has ended.
_WRITTEN: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a temporary folder, but only if all tasks run in this process (master local); on a cluster an
    unset folder is an error, as the executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="ticketloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that a lost executor costs no recomputation.

    The table carries the hint to join by sorting and merging: its compressed files say little about its rows, so the
    optimiser's estimate must not choose a broadcast. broadcast() around it, after a check of its size, still counts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext
    out = spark.read.schema(df.schema).parquet(path).hint("merge")
    out._ticketloom_path = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether df is itself a table of materialize()."""
    return hasattr(df, "_ticketloom_path")


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_ticketloom_path", None)
        if path in _WRITTEN:
            _delete(path)


def release(spark: SparkSession) -> None:
    """Deletes every table that this process has written in the session: to be called when its results are stored elsewhere."""
    for path in [p for p, (_, _, context) in _WRITTEN.items() if context is spark.sparkContext]:
        _delete(path)


def _delete(path: str) -> None:
    jvm, conf, _ = _WRITTEN.pop(path)
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _at_exit() -> None:
    try:
        for path in list(_WRITTEN):
            _delete(path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(df: DataFrame) -> bool:
    """Whether a table of materialize() is still there."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._ticketloom_path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(where)
