"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.shared import materialize, new_path, release, shared_dir

__all__ = ["materialize", "new_path", "release", "shared_dir"]

# The white space that separates words: space and code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch of rows that goes to a Python worker where an operator asks for small ones.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, columns: tuple[int, ...], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``most`` bytes in its text columns, so that
    only a run at a time is made Python objects."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, at = np.cumsum(size), 0
    while at < len(batch):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most)))
        yield batch.slice(at, end - at)
        at = end


def trim() -> None:
    """Give freed memory that Arrow's pool and the C library keep back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Let go of what ran before: plans that Python still names in the driver's JVM,
    what they held there, and freed memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def give_back_everywhere(spark: SparkSession) -> None:
    """:func:`give_back`, and a collection in the executors, whose heaps else stay as
    large as the largest plan before made them: a task for each core, of no rows' work."""
    give_back(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").collect()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a ``mapInArrow``; at a task's end its worker, which stays for later
    tasks and idles beside plans without Python, gives freed memory back."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return to_the_end


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes to Python workers in batches of about ``BATCH_BYTES``,
    as both sides hold a batch whole, outside the heap.  A size that the session was
    given stays."""
    if spark.conf.get(_BATCH_KEY, None):
        yield
        return
    spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_KEY)


def materialize_mapped(df: DataFrame, tag: str) -> DataFrame:
    """:func:`materialize` for a plan that hands texts to Python workers, in small batches."""
    with small_batches(df.sparkSession):
        return materialize(df, tag)


def unused(df: DataFrame, name: str, n: int = 1) -> list[str]:
    """``n`` column names that ``df`` does not have, in any case."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (found := f"__{name}_{k}") not in taken:
            out.append(found)
        k += 1
    return out


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array, on the JVM."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def doc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: dict, seed: int) -> DataFrame:
    """(doc_id, text, y): a bounded sample of the labelled rows outside fold ``held``.

    ``most`` bounds the rows of each label, or of all (None).  Ids are taken by
    a hash.  An id labelled both ways is left out, and of rows that repeat an id
    the one whose text has the least hash is taken, so that reruns agree.
    """
    y = F.col(label)
    rows = labels.select(F.col("doc_id").alias("label_id"), y.cast("int").alias("y")).filter("label_id is not null and y in (0, 1)")
    rows = rows.filter(doc_fold(F.col("label_id"), folds) != held)
    docs = docs.select("doc_id", "text").filter("text is not null")
    rows = rows.join(docs.select("doc_id"), F.col("label_id") == F.col("doc_id"), "left_semi")
    rows = rows.groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    order = F.xxhash64("label_id", F.lit(seed))
    picked = [(rows if c is None else rows.filter(F.col("y") == c)).orderBy(order, "label_id").limit(n) for c, n in most.items()]
    ids = picked[0]
    for more in picked[1:]:
        ids = ids.unionByName(more)
    # The ids are bounded by ``most``.
    found = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")
    return found.groupBy("doc_id", "y").agg(first).select("doc_id", "first.text", "y")
