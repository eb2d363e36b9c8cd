"""Tables and folders that driver and executors share while a session lasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (tests); on a
    cluster it is an error, as a machine-local folder would lose data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/brindle-{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that outlives a lost executor, and gives
    the planner the table's true size for its choice of joins.
    """
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete what :func:`new_path` named; call it when results were read."""
    for session, path in [x for x in _made if x[0] is spark]:
        _delete(session, path)
        _made.remove((session, path))


@atexit.register
def _release_all() -> None:
    for session, path in _made:
        try:
            _delete(session, path)
        except Exception:  # the session may be gone when Python ends; others may not
            continue
