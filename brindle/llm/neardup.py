"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles.  For each of ``BANDS * ROWS /
2`` permutations both the least and the greatest value are kept, so one hash
evaluation gives two signature values; bands of the least values and bands of
the greatest ones are looked up alike.  At a similarity of 0.8 the chance
that no band agrees is (1 - 0.8**5) ** 32 = 3e-6 for a pair.

Documents with equal sets form a class first (a digest of the whole set,
counted map-side, so thousands of copies are one row per task).  Links are
then looked for between classes in three rounds, none of which emits all
pairs of a group: (1) each class against the least class it shares a band
with, (2) each member of a group that is not yet joined to the group's least
member (its hub), against that one, (3) what is still apart from a hub,
against all that share the hub, in blocks with an inverted index.  Every pair whose sizes allow a link is confirmed on the full
sets, made anew from the whole texts.  Components come from contraction.

Defined results: null, empty or blank text has an empty set and is linked
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows that share a doc_id are one node (their links are united),
except in ``keep_one``, where each is judged by its own text; a
null doc_id is linked with nothing and its component is null; an empty table
gives an empty result; other columns are ignored by ``classify`` and pass
through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

BANDS, ROWS = 32, 5
SIMILARITY = (80, 100)
SHINGLE_WORDS = 5
KNOWN_WORDS = 200_000
_SEED = 0x9E3779B97F4A7C15


class _Words(dict):
    """Word to index, with a hash per index; unknown words are added."""

    def __init__(self):
        self.hashes: list[int] = []
        self.array = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = i = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.hashes, self.array = [], self.array[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.array) < len(self.hashes):
            self.array = np.concatenate((self.array, np.array(self.hashes[len(self.array) :], np.uint64)))
        return self.array[at]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int, words: _Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text, over all its words."""
    split = [(t or "").encode().lower().split() for t in texts]
    lengths = [len(x) for x in split]
    h = words.of([w for x in split for w in x])
    out, at = [], 0
    for n in lengths:
        mine, k = h[at : at + n], min(width, n)
        at += n
        if not n:
            out.append(mine)
            continue
        acc = mine[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * np.uint64(_SEED) + mine[j : n - k + 1 + j]
        out.append(np.unique(_mix(acc + np.uint64(k))))
    return out


def permutations(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], multipliers: np.ndarray) -> np.ndarray:
    """Least and then greatest 32-bit values of non-empty sets, a row per set."""
    n = len(multipliers)
    out = np.empty((len(sets), 2 * n), np.uint32)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    for i, m in enumerate(multipliers):
        v = ((flat * m) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(v, starts)
        out[:, n + i] = np.maximum.reduceat(v, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        key = _mix(key * np.uint64(_SEED) + parts[:, :, j])
    return key.view(np.int64)


_SIGNED = "doc_id bigint, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>"
_SIGNED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words, multipliers = _Words(), permutations(bands * rows // 2)
        for batch in batches:
            for run in common.slices(batch, (1,)):
                sets = shingle_sets(run.column(1).to_pylist(), width, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(run)
                digests = np.zeros((len(run), 2), np.int64)
                if full:
                    found = band_keys(signatures([sets[i] for i in full], multipliers), bands, rows)
                    for i, k in zip(full, found, strict=True):
                        keys[i] = k
                        digests[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), np.int64)
                yield pa.RecordBatch.from_arrays([run.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys, pa.list_(pa.int64()))], schema=_SIGNED_ARROW)

    return common.trimmed(sign)


def _confirmer(width: int, similarity: tuple[int, int]):
    part, whole = similarity

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hub, hub_set = _Words(), None, None
        for batch in batches:
            for run in common.slices(batch, (2, 3)):
                sets, out = shingle_sets(run.column(2).to_pylist(), width, words), []
                for a, b, text_b, s in zip(*(run.column(c).to_pylist() for c in (0, 1, 3)), sets, strict=True):
                    if hub != (b, text_b):
                        hub, hub_set = (b, text_b), shingle_sets([text_b], width, words)[0]
                    common_n = len(np.intersect1d(s, hub_set, assume_unique=True))
                    if whole * common_n >= part * (len(s) + len(hub_set) - common_n) and common_n:
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return common.trimmed(confirm)


#: A bitmap of ids has at most so many bits (8 MB).
MOST_BITS = 1 << 26


def _texts_of(texts: DataFrame, rows: DataFrame, column: str, n: int) -> DataFrame:
    """(``column``, text) of every document that ``column`` of the ``n`` rows names,
    and of a few others: a bitmap of hashed ids goes to the texts where they are
    read, so that the join which follows moves little more than it needs.  Of ids
    beyond a sixteenth of ``MOST_BITS`` more others pass; none that is named is lost."""
    bits = min(MOST_BITS, 1 << max(15, (16 * n).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(bits)) + 1
    bitmap = rows.select(at(column).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
    bitmap = bitmap.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    placed = texts.select(F.col("doc_id").alias(column), "text", F.bitmap_bucket_number(at("doc_id")).alias("part"), F.bitmap_bit_position(at("doc_id")).cast("int").alias("bit"))
    is_set = F.expr("shiftright(cast(conv(hex(substring(bitmap, bit div 8 + 1, 1)), 16, 10) AS int), bit % 8) % 2 = 1")
    return placed.join(F.broadcast(bitmap), "part").filter(is_set).select(column, "text")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int], tag: str) -> DataFrame:
    """Those of ``pairs`` (a, b), a written table, whose full sets are similar enough."""
    n = pairs.count()
    with_a = pairs.join(_texts_of(texts, pairs, "a", n).withColumnRenamed("text", "text_a"), "a")
    both = with_a.join(_texts_of(texts, pairs, "b", n).withColumnRenamed("text", "text_b"), "b")
    return common.materialize_mapped(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmer(width, similarity), "a bigint, b bigint"), tag)


#: At most so many documents, and about so many shingles, on either side of a block.
LEFT, RIGHT = 256, 1024
LEFT_SHINGLES, RIGHT_SHINGLES = 1 << 18, 1 << 20
#: A hub's nodes are dealt over so many buckets wherever rows meet by hub.
BUCKETS = 64


def _block_linker(width: int, similarity: tuple[int, int]):
    part, whole = similarity

    def link(table: pa.Table) -> pa.Table:
        """Exact similarity of a block's left sets with its right ones through an
        inverted index; one link per left document and component is enough."""
        words, sets = _Words(), []
        for batch in table.select(["text"]).to_batches():
            for run in common.slices(batch, (0,)):
                sets += shingle_sets(run.column(0).to_pylist(), width, words)
        rows = table.drop_columns(["text"]).to_pylist()
        right = [i for i, r in enumerate(rows) if not r["is_left"]]
        out = []
        if right:
            sizes = np.array([len(sets[i]) for i in right])
            flat, owner = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            components = np.array([rows[i]["component"] for i in right])
            for i, r in enumerate(rows):
                if not r["is_left"] or not len(sets[i]):
                    continue
                low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(right))
                hit = (shared > 0) & (whole * shared >= part * (len(sets[i]) + sizes - shared)) & (components != r["component"])
                for j in {int(c): int(j) for j, c in zip(np.flatnonzero(hit), components[hit], strict=True)}.values():
                    out.append((r["node"], rows[right[j]]["node"]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    def trimmed(table: pa.Table) -> pa.Table:
        links = link(table)
        common.trim()
        return links

    return trimmed


def _by_hub(units: DataFrame, *totals) -> DataFrame:
    """(hub, bucket, totals): totals of a hub beside each bucket that it fills.

    Rows are first counted by hub and bucket, so that a hub with a third of
    all rows is ``BUCKETS`` rows where it meets in one task."""
    some = units.groupBy("hub", "bucket").agg(*(f(F.col(c)).alias(c) for c, f in totals))
    whole = some.groupBy("hub").agg(*(f(F.col(c)).alias(c) for c, f in totals))
    return some.select("hub", "bucket").join(whole, "hub")


def _linked_apart(apart: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame | None:
    """Links (a, b) between nodes that share a hub and are still in different
    components.  The nodes outside the hub's component are the left side, all
    nodes the right one; both are cut into blocks by numbers of documents and of
    shingles, so a row is copied once per opposite block and no task holds more
    than a block pair.  None if there is nothing left to compare (a hub and one
    node were compared before)."""
    units = apart.select("hub", "node", "component").distinct().join(sizes, "node")
    units = common.materialize(units.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(BUCKETS))), "dup-units")
    own = units.select("hub", "bucket", F.when(F.col("node") == F.col("hub"), F.col("component")).alias("hub_component"), F.lit(1).alias("n"), F.col("n").alias("n_shingles"))
    own = _by_hub(own, ("hub_component", F.max), ("n", F.sum), ("n_shingles", F.sum)).filter("n > 2").withColumnsRenamed({"n": "n_right", "n_shingles": "right_shingles"})
    units = units.join(own, ["hub", "bucket"]).withColumn("is_left", F.col("component") != F.col("hub_component"))
    left = units.filter("is_left").withColumn("n_left", F.lit(1)).withColumn("left_shingles", F.col("n"))
    totals = left.groupBy("hub", "bucket").agg(F.sum("n_left").alias("n_left"), F.sum("left_shingles").alias("left_shingles"))
    totals = totals.groupBy("hub").agg(F.sum("n_left").alias("n_left"), F.sum("left_shingles").alias("left_shingles"))
    counts = own.join(totals, "hub").select(
        "hub", "bucket",
        F.greatest(F.ceil(F.col("n_left") / LEFT), F.ceil(F.col("left_shingles") / LEFT_SHINGLES)).alias("lefts"),
        F.greatest(F.ceil(F.col("n_right") / RIGHT), F.ceil(F.col("right_shingles") / RIGHT_SHINGLES)).alias("rights"),
    )
    units = units.join(common.materialize(counts, "dup-counts"), ["hub", "bucket"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = units.filter("is_left").select("hub", F.pmod(F.xxhash64("node"), F.col("lefts")).alias("i"), every("rights").alias("j"), "node", "component", "is_left")
    right = units.select("hub", every("lefts").alias("i"), F.pmod(F.xxhash64("node"), F.col("rights")).alias("j"), "node", "component", F.lit(False).alias("is_left"))
    blocks = common.materialize(left.unionByName(right), "dup-blocks")
    if not (n := blocks.count()):
        return None
    filled = blocks.join(_texts_of(texts, blocks, "node", n), "node")
    return common.materialize_mapped(filled.groupBy("hub", "i", "j").applyInArrow(_block_linker(width, similarity), "a bigint, b bigint"), "dup-links")


def classify(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text)."""
    part, whole = similarity
    common.give_back(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    signed = common.materialize_mapped(texts.mapInArrow(_signer(shingle_words, bands, rows), _SIGNED), "dup-signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = common.materialize(full.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n")), "dup-classes")
    # The sizes of a representative's sets (several where rows repeat an id) go with it, so that no join by hub is needed.
    ranges = classes.groupBy("rep").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    named = classes.join(ranges, "rep").select("d0", "d1", F.col("rep").alias("doc_id"), "lo", "hi")
    reps = full.join(named, ["d0", "d1", "doc_id"])
    banded = reps.select(F.col("doc_id").alias("node"), "n_shingles", "lo", "hi", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.min_by("lo", "node").alias("hub_lo"), F.min_by("hi", "node").alias("hub_hi"))
    shared = shared.filter("hub < last").drop("last")
    banded = banded.drop("lo", "hi")
    members = common.materialize(banded.join(shared, "key"), "dup-members")
    sizes = members.groupBy("node").agg(F.max("n_shingles").alias("n"))
    texts = texts.filter("doc_id is not null")
    # Whether the sizes of a node's set and of its hub's allow a link.
    possible = (F.col("hub_hi") * whole >= F.col("n_shingles") * part) & (F.col("n_shingles") * whole >= F.col("hub_lo") * part)

    tested = members.filter("node <> hub").filter(possible).groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b"))
    tested = common.materialize(tested, "dup-pairs")
    # Rows of a class that share a doc_id with another class are united as well.
    same = full.join(classes, ["d0", "d1"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = common.materialize(_confirmed(tested, texts, shingle_words, similarity, "dup-links").unionByName(same), "dup-edges")
    found = connected_components(edges)

    def apart() -> DataFrame:
        """Members of band groups that hold more than one component."""
        placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key")
        return common.materialize(placed.join(mixed, "key").select("key", "node", "n_shingles", "hub", "hub_lo", "hub_hi", "component"), "dup-apart")

    common.give_back(docs.sparkSession)
    placed = apart()
    own = placed.filter("node = hub").select("key", F.col("component").alias("cb"))
    pairs = placed.join(own, "key").filter("component <> cb").filter(possible).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = common.materialize(pairs.join(tested, ["a", "b"], "left_anti"), "dup-pairs")
    for more in (lambda: _confirmed(pairs, texts, shingle_words, similarity, "dup-links"), lambda: _linked_apart(apart(), sizes, texts, shingle_words, similarity)):
        new = more()
        if new is not None and not new.isEmpty():
            edges = edges.unionByName(new)
            found = connected_components(edges)
    out = signed.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def contract(docs: DataFrame, shingle_words: int = 2) -> DataFrame:
    found = classify(docs, shingle_words)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows of ``docs`` without the near duplicates: of each component the row
    with the smallest doc_id stays, and one of rows that repeat both doc_id and
    text.  A row is named by a digest of the two, so that rows which share a
    doc_id stand or fall by their own texts."""
    (name,) = common.unused(docs, "node")
    rows = docs.filter(F.col("doc_id").isNotNull()).withColumn(name, F.xxhash64("doc_id", "text"))
    found = classify(rows.select(F.col(name).alias("doc_id"), "text"), shingle_words).select(F.col("doc_id").alias("node"), "component_id")
    ids = rows.select(F.col(name).alias("node"), F.col("doc_id").alias("id")).distinct()
    first = found.distinct().join(ids, "node").groupBy("component_id").agg(F.min(F.struct("id", "node")).alias("first"))
    named = rows.join(first.select(F.col("first.node").alias(name)), name, "left_semi").dropDuplicates([name])
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
