"""Nearest neighbours: exact for one query or many, and by an inverted file of cells.

Searches for many queries compare blocks of vectors with blocks of queries, one
matrix product each, and keep the k best of every query before anything is
shuffled.  Distances of the vectors that come into question are then worked
out pair by pair in double precision, so that ranks do not depend on blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.distance import METRICS
from brindle.sources import shared

#: Vectors and queries that meet in one matrix product.
BASE_BLOCK, QUERY_BLOCK = 16_384, 1024
#: Entries of the matrix that is worked out at once, and rows that a query's cells are given out in.
MATRIX, PLACED = 1 << 21, 1 << 16
#: How many more than k are worked out pair by pair.
MARGIN = 16
_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])


def knn(base: DataFrame, query: list[float], k: int, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rank, vec_id, distance): the k closest to one query, ties by id.

    The query is a literal, so this is one scan and a top-k per task.
    """
    if k <= 0:
        return base.select(F.lit(0).alias("rank"), vec_id, F.lit(0.0).alias("distance")).filter("false")
    q = F.array(*(F.lit(float(x)).cast("float") for x in query))
    known = base.filter(F.col(vector).isNotNull())  # a null vector is no one's neighbour
    top = known.select(vec_id, METRICS[metric](F.col(vector), q).alias("distance")).orderBy("distance", vec_id).limit(k)
    return top.select(F.row_number().over(Window.orderBy("distance", vec_id)).alias("rank"), vec_id, "distance")


def _distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of ``x`` from rows of ``y``, pair by pair."""
    if metric == "l2":
        return np.sqrt(((x - y) ** 2).sum(-1))
    dots = (x * y).sum(-1)
    if metric == "dot":
        return -dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / (np.sqrt((x * x).sum(-1)) * np.sqrt((y * y).sum(-1)))


def _rough(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """A matrix (queries by vectors) whose rows are ordered like the distances, but for rounding."""
    dots = q @ x.T
    if metric == "l2":
        return (x * x).sum(1)[None] - 2 * dots
    if metric == "dot":
        return -dots
    norms = np.sqrt((x * x).sum(1))
    return np.where(norms > 0, -dots / np.where(norms > 0, norms, 1), np.inf)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, distance) of the k closest of a block for each query of a block."""
    step = max(1, MATRIX // max(1, len(ids)))
    if len(q) > step:
        parts = [nearest(ids, x, query_ids[a : a + step], q[a : a + step], k, metric) for a in range(0, len(q), step)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))
    rough = _rough(x, q, metric)
    some = min(len(ids), k + MARGIN)
    near = np.argpartition(rough, some - 1, axis=1)[:, :some] if some < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
    d = _distances(x[near], q[:, None], metric)
    # What has no distance (NaN) comes last.
    order = np.lexsort((ids[near], np.where(np.isnan(d), np.inf, d)), axis=1)[:, :k]
    rows = np.arange(len(q))[:, None]
    return np.repeat(query_ids, order.shape[1]), ids[near][rows, order].ravel(), d[rows, order].ravel()


def _unpacked(cell) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a list of (id, vector)."""
    flat = cell.values
    ids, vectors = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(ids) and len(x) % len(ids) or len(set(np.diff(vectors.offsets.to_numpy())[: len(ids)].tolist())) > 1:
        raise ValueError("vectors differ in length")
    return ids, x.reshape(len(ids), -1)


def _matcher(k: int, metric: str):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, asked in zip(*batch.columns, strict=True):
                (ids, x), (query_ids, q) = _unpacked(base), _unpacked(asked)
                if x.shape[1] != q.shape[1]:
                    raise ValueError("vectors differ in length")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in nearest(ids, x, query_ids, q, k, metric)], schema=_PAIRS)
        pa.default_memory_pool().release_unused()

    return match


def _packed(rows: DataFrame, vec_id: str, vector: str, size: int, *by: str) -> DataFrame:
    """(by, block, list): lists of about ``size`` (id, vector), null vectors left out."""
    rows = rows.filter(F.col(vector).isNotNull())
    if by:  # a row for each cell of an index, of which there is a stated number
        rows = rows.join(F.broadcast(rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("blocks"))), list(by))
    else:
        rows = rows.withColumn("blocks", F.lit(max(1, -(-rows.count() // size))))
    entry = F.struct(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    dealt = rows.select(*by, F.pmod(F.xxhash64(vec_id), "blocks").alias("block"), entry.alias("x"))
    return dealt.groupBy(*by, "block").agg(F.collect_list("x").alias("list"))


def _ranked(pairs: DataFrame, k: int, vec_id: str) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k best per query, of the k best of each block."""
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vec_id").alias(vec_id), "distance")


def knn_join(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance) for a stated set of queries against all rows.

    Blocks of queries, which are small, are copied to each block of vectors.  The
    planner does not count the copies, so they are never broadcast; a partition for
    each block of vectors keeps AQE from joining them into few tasks.
    """
    blocks = shared.materialize(_packed(base, vec_id, vector, BASE_BLOCK).withColumnsRenamed({"block": "i", "list": "base"}), "knn-base")
    asked = _packed(queries, vec_id, vector, QUERY_BLOCK).select(F.col("list").alias("asked"))
    n = blocks.agg(F.coalesce(F.max("i"), F.lit(-1))).first()[0]
    spread = asked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)).cast("array<bigint>")) if n >= 0 else F.lit(None).cast("bigint"))
    met = spread.repartition(n + 1, "i").hint("merge").join(blocks.repartition(n + 1, "i"), "i").select("base", "asked") if n >= 0 else spread.join(blocks, "i").select("base", "asked")
    return _ranked(met.mapInArrow(_matcher(k, metric), "query_id bigint, vec_id bigint, distance double"), k, vec_id)


# The inverted file.


def as_l2(x: np.ndarray, metric: str, top: float, query: bool) -> np.ndarray:
    """Vectors among which the order by euclidean distance is that by ``metric``:
    directions for cosine; for dot one more coordinate that makes all vectors as
    long as the longest (``top``), and is 0 in queries."""
    if metric == "cosine":
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    if metric == "dot":
        more = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, top**2 - (x * x).sum(1, keepdims=True)))
        return np.concatenate((x, more), 1)
    return x


def _cell_order(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first."""
    d = (centres * centres).sum(1)[None] - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _placer(centres: np.ndarray, n: int, metric: str, top: float, query: bool):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                # A row is given out n times, and compared with all cells.
                step = max(1, min(PLACED // n, MATRIX // len(centres)))
                for some in (batch.slice(a, step) for a in range(0, len(batch), step)):
                    ids, x = some.column(0), np.array(some.column(1).to_pylist(), np.float64)
                    cells = _cell_order(as_l2(x, metric, top, query), centres, n)
                    at = np.repeat(np.arange(len(ids)), cells.shape[1])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), some.column(1).take(pa.array(at)), pa.array(cells.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return place


@dataclass
class IvfIndex:
    """A stored index: packed blocks of every vector by cell, and the centres of the cells."""

    centres: np.ndarray
    path: str | None
    metric: str
    top: float
    probes: int
    vec_id: str
    vector: str

    def rows(self, spark) -> DataFrame:
        """(cell, block, list) as stored, in folders by cell."""
        return spark.read.parquet(self.path)

    def _placed(self, queries: DataFrame, probes: int) -> DataFrame:
        asked = queries.filter(F.col(self.vector).isNotNull()).select(F.col(self.vec_id).cast("bigint").alias("id"), F.col(self.vector).cast("array<float>").alias("v"))
        return asked.mapInArrow(_placer(self.centres, probes, self.metric, self.top, True), "id bigint, v array<float>, cell int")

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, distance): the k closest among the cells nearest to
        each query, ``probes`` of them (as fitted, if None); all cells make it exact.

        Only folders of cells that are asked for are read; blocks of queries
        meet blocks of vectors by cell.  A query is in as many blocks as it asks
        cells, whose files compress to little, so the planner must not broadcast them."""
        if not len(self.centres) or k <= 0:
            none = queries.select(F.col(self.vec_id).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), F.col(self.vec_id), F.lit(0.0).alias("distance"))
            return none.filter("false")
        spark = queries.sparkSession
        placed = shared.materialize(self._placed(queries, min(probes or self.probes, len(self.centres))), "ivf-asked")
        asked = _packed(placed, "id", "v", QUERY_BLOCK, "cell").select("cell", F.col("list").alias("asked"))
        wanted = [r[0] for r in placed.select("cell").distinct().collect()]  # of a stated number of cells
        met = self.rows(spark).filter(F.col("cell").isin(wanted)).join(asked.hint("merge"), "cell").select(F.col("list").alias("base"), "asked")
        return _ranked(met.mapInArrow(_matcher(k, self.metric), "query_id bigint, vec_id bigint, distance double"), k, self.vec_id)

    def search(self, spark, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(rank, vec_id, distance) for a single query."""
        one = spark.createDataFrame([(0, [float(x) for x in query])], f"{self.vec_id} bigint, {self.vector} array<float>")
        return self.search_many(one, k, probes).drop("query_id")


def _fit_centres(x: np.ndarray, cells: int, rounds: int, g: np.random.Generator) -> np.ndarray:
    centres = x[g.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = _cell_order(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _fit_probes(x: np.ndarray, queries: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int, g: np.random.Generator) -> int:
    """How many cells hold ``recall`` of the sample's k nearest, over queries of the sample."""
    pick = g.choice(len(x), min(asked, len(x)), replace=False)
    d = (x * x).sum(1)[None] - 2 * queries[pick] @ x.T
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x))]
    cell = _cell_order(x, centres, 1)[:, 0]
    place = np.argsort(_cell_order(queries[pick], centres, len(centres)), axis=1)  # of each cell in a query's order
    found = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def _least_hashes(rows: DataFrame, n: int, most: int, seed: int) -> list:
    """The vectors of the ``most`` rows (of ``n``) whose ids have the least hashes.

    Every task sends the driver as many as are asked for, so those that are likely
    among the least of all, by their hash, are picked before."""
    h, share = F.xxhash64("id", F.lit(seed)), (1.1 * most + 1000) / n
    least = lambda some: some.orderBy(h, "id").limit(most).select("v").collect()
    found = least(rows.filter(h < F.lit(int(share * 2**64) - 2**63))) if share < 1 else least(rows)
    return found if len(found) >= min(most, n) else least(rows)


def build_ivf(base: DataFrame, cells: int | None = None, rounds: int = 8, sample_rows: int = 20_000, recall: float = 0.96, k: int = 10, seed: int = 5, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding", path: str | None = None) -> IvfIndex:
    """Fit cells on a bounded sample, then store every row under its cell.

    The sample is ``sample_rows`` rows by hashed id.  ``cells`` defaults to the
    square root of the rows, 1024 at most.  The number of cells that a search
    looks at is fitted as well: the least that finds ``recall`` of the ``k``
    nearest rows of the sample for 512 of its rows.  The index is written under
    ``path`` (by default, in the session's shared folder) in folders by cell;
    a cell of any size is many blocks."""
    spark = base.sparkSession
    rows = base.filter(F.col(vector).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).alias("top")).first()
    if not facts["n"]:
        return IvfIndex(np.zeros((0, 0)), None, metric, 0.0, 0, vec_id, vector)
    sample = _least_hashes(rows, facts["n"], sample_rows, seed)
    raw = np.array([r[0] for r in sample], np.float64)
    x = as_l2(raw, metric, facts["top"], False)
    g = np.random.default_rng(seed)
    centres = _fit_centres(x, cells or min(1024, max(1, round(facts["n"] ** 0.5))), rounds, g)
    probes = _fit_probes(x, as_l2(raw, metric, facts["top"], True), centres, k, recall, 512, g)
    placed = rows.mapInArrow(_placer(centres, 1, metric, facts["top"], False), "id bigint, v array<float>, cell int")
    path = path or shared.new_path(spark, "ivf")
    _packed(shared.materialize(placed, "ivf-placed"), "id", "v", BASE_BLOCK, "cell").repartition("cell").write.partitionBy("cell").option("compression", "zstd").parquet(path)
    return IvfIndex(centres, path, metric, facts["top"], probes, vec_id, vector)
