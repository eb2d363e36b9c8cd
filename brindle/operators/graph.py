"""Nearest neighbours by layered proximity graphs, one for each shard of the rows.

A graph is built by adding vectors one by one.  Each gets a level drawn from a
geometric law; on every layer up to it, a beam search finds the closest
vectors, of which a diverse few become neighbours: one is taken if it is closer
to the new vector than to any taken before.  Searches walk greedily down from
the top layer and run a beam of width ``ef`` on the lowest.

A shard has about ``SHARD_ROWS`` vectors, so graphs are built and searched
side by side, each as one row of a stored table.  A query is asked of every
shard, in blocks, and the best of all are ranked.  So there are ``SHARDS`` at
most, which have more vectors then: a search in a larger graph takes hardly
longer, while searches in ever more of them would grow with the square of the
rows.  Cosine and dot
products are searched as euclidean distances (see :func:`vector.as_l2`);
distances given back are those of the metric.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import vector as V
from brindle.sources import shared

SHARD_ROWS, SHARDS = 4096, 12


class Graph:
    """Neighbours of vectors ``x`` on each layer: ``links[layer][i]`` lists those of i."""

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 100, seed: int = 1):
        self.x, self.m, self.ef = np.ascontiguousarray(x, np.float32), m, ef
        self.squares = (self.x * self.x).sum(1)
        self.links: list[dict[int, np.ndarray]] = []
        self.entry = -1
        g = np.random.default_rng(seed)
        for i, u in enumerate(g.random(len(x))):
            self._add(i, int(-math.log(1 - u) / math.log(max(2, m))))

    def _most(self, layer: int) -> int:
        return self.m if layer else 2 * self.m

    def _apart(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of a vector from some of the graph's, less its own square."""
        return self.squares[at] - 2 * (self.x[at] @ q)

    def _beam(self, q: np.ndarray, starts: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """The closest that a beam of ``width`` reaches, closest first."""
        links = self.links[layer]
        first = self._apart(q, np.array(starts))
        ahead = list(zip(first.tolist(), starts, strict=True))
        heapq.heapify(ahead)
        best = [(-d, i) for d, i in ahead]
        heapq.heapify(best)
        seen = set(starts)
        while ahead:
            d, i = heapq.heappop(ahead)
            if d > -best[0][0] and len(best) >= width:
                break
            new = [j for j in links[i].tolist() if j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._apart(q, np.array(new)).tolist(), new, strict=True):
                if len(best) < width or e < -best[0][0]:
                    heapq.heappush(ahead, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _diverse(self, q: np.ndarray, found: list[int], most: int) -> np.ndarray:
        """Neighbours for ``q`` from ``found`` (closest first): each closer to it than
        to those taken before, filled up with the closest of the rest."""
        at = np.array(found)
        near = self._apart(q, at) + float(q @ q)
        between = self.squares[at][:, None] + self.squares[at][None] - 2 * (self.x[at] @ self.x[at].T)
        taken: list[int] = []
        for k in range(len(at)):
            if len(taken) == most:
                break
            if not taken or near[k] < between[k, taken].min():
                taken.append(k)
        taken += [k for k in range(len(at)) if k not in set(taken)][: most - len(taken)]
        return at[taken]

    def _add(self, i: int, level: int) -> None:
        top, q = len(self.links) - 1, self.x[i]
        starts = [self.entry]
        for layer in range(top, level, -1):
            starts = [self._beam(q, starts, 1, layer)[0][1]]
        for layer in range(min(top, level), -1, -1):
            found = [j for _, j in self._beam(q, starts, self.ef, layer)]
            links = self.links[layer]
            links[i] = self._diverse(q, found, self.m)
            for j in links[i].tolist():
                mine = np.append(links[j], i)
                if len(mine) > self._most(layer):
                    mine = mine[np.argsort(self._apart(self.x[j], mine), kind="stable")]
                    mine = self._diverse(self.x[j], mine.tolist(), self._most(layer))
                links[j] = mine
            starts = found
        while len(self.links) <= level:
            self.links.append({i: np.zeros(0, np.int64)})
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int = 50) -> list[int]:
        """The k closest that a beam of ``ef`` finds, closest first."""
        if self.entry < 0 or k <= 0:
            return []
        q, starts = np.asarray(q, np.float32), [self.entry]
        for layer in range(len(self.links) - 1, 0, -1):
            starts = [self._beam(q, starts, 1, layer)[0][1]]
        return [i for _, i in self._beam(q, starts, max(k, ef), 0)[:k]]

    def tables(self) -> tuple[int, list[np.ndarray]]:
        """Entry, and for each layer a flat (node, degree, neighbours ...) list."""
        return self.entry, [np.concatenate([np.array([i, len(n), *n], np.int32) for i, n in layer.items()]) for layer in self.links]

    @classmethod
    def of(cls, x: np.ndarray, entry: int, layers: list[np.ndarray]) -> Graph:
        out = cls(np.zeros((0, x.shape[1])))
        out.x, out.squares, out.entry = np.ascontiguousarray(x, np.float32), (x * x).sum(1).astype(np.float32), entry
        for flat in layers:
            links, at = {}, 0
            while at < len(flat):
                links[int(flat[at])] = flat[at + 2 : at + 2 + flat[at + 1]].astype(np.int64)
                at += 2 + int(flat[at + 1])
            out.links.append(links)
        return out


_STORED = "shard bigint, ids array<bigint>, vectors binary, dim int, entry int, layers array<binary>"


def _builder(metric: str, top: float, m: int, ef: int):
    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")  # so that reruns build the same graph
        x = np.array(table.column("v").to_pylist(), np.float32)[order]
        entry, layers = Graph(V.as_l2(x.astype(np.float64), metric, top, False), m, ef).tables()
        row = {"shard": table.column("shard")[0].as_py(), "ids": ids[order].tolist(), "vectors": x.tobytes(), "dim": x.shape[1], "entry": entry, "layers": [layer.tobytes() for layer in layers]}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("dim", pa.int32()), ("entry", pa.int32()), ("layers", pa.list_(pa.binary()))]))

    return build


def _asker(metric: str, top: float, k: int, ef: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, asked = batch.select(["ids", "vectors", "dim", "entry", "layers"]), batch.column("asked")
            for i in range(len(batch)):  # one at a time, as a graph is many Python objects
                row = shards.slice(i, 1).to_pylist()[0]
                x = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
                graph = Graph.of(V.as_l2(x.astype(np.float64), metric, top, False), row["entry"], [np.frombuffer(b, np.int32) for b in row["layers"]])
                ids, (query_ids, q) = np.array(row["ids"]), V._unpacked(asked[i])
                found = []
                for a, raw, moved in zip(query_ids.tolist(), q, V.as_l2(q, metric, top, True), strict=True):
                    near = np.array(graph.search(moved, k, ef), np.int64)
                    found.append((np.full(len(near), a), ids[near], V._distances(x[near].astype(np.float64), raw[None], metric)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=V._PAIRS)
        pa.default_memory_pool().release_unused()

    return ask


@dataclass
class GraphIndex:
    """Stored graphs, a row for each shard."""

    path: str | None
    metric: str
    top: float
    vec_id: str
    vector: str

    def search_many(self, queries: DataFrame, k: int, ef: int = 100) -> DataFrame:
        """(query_id, rank, vec_id, distance) of the k closest that beams of ``ef`` find."""
        spark = queries.sparkSession
        if self.path is None or k <= 0:
            return queries.select(F.col(self.vec_id).cast("bigint").alias("query_id"), F.lit(0).alias("rank"), F.col(self.vec_id), F.lit(0.0).alias("distance")).filter("false")
        stored = spark.read.schema(_STORED).parquet(self.path)
        # Blocks of queries, which are small, are copied to each shard.
        asked = V._packed(queries, self.vec_id, self.vector, V.QUERY_BLOCK).select(F.col("list").alias("asked"))
        n = stored.agg(F.max("shard")).first()[0]
        spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n)).cast("array<bigint>")))
        met = spread.repartition(n + 1, "shard").hint("merge").join(stored.repartition(n + 1, "shard"), "shard").select("ids", "vectors", "dim", "entry", "layers", "asked")
        return V._ranked(met.mapInArrow(_asker(self.metric, self.top, k, ef), "query_id bigint, vec_id bigint, distance double"), k, self.vec_id)


def build_graph(base: DataFrame, m: int = 16, ef: int = 100, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding", path: str | None = None) -> GraphIndex:
    """Build and store graphs of every row: ``m`` neighbours a layer (twice that on the
    lowest), chosen from a beam of ``ef``."""
    spark = base.sparkSession
    rows = base.filter(F.col(vector).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).alias("top")).first()
    if not facts["n"]:
        return GraphIndex(None, metric, 0.0, vec_id, vector)
    path = path or shared.new_path(spark, "graph")
    shards = min(SHARDS, -(-facts["n"] // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    dealt.groupBy("shard").applyInArrow(_builder(metric, facts["top"], m, ef), _STORED).write.option("compression", "zstd").parquet(path)
    return GraphIndex(path, metric, facts["top"], vec_id, vector)
