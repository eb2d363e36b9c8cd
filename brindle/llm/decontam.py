"""Benchmark decontamination by MinHash containment search, in DataFrame functions alone.

Items are short, documents long, so a signature of a whole document says
nothing about one item.  Instead each item keeps its least shingle hashes (a
one-permutation MinHash sketch), and a document contains an item only if it
holds most of them.  Items fall into parts by size, up to ``2**p`` shingles.
Each part has its own sketch size, the least that leaves an item at the
threshold unseen with a probability of at most 1e-6 (items of a few shingles
are never missed: the sketch holds one hash more than a document may lack),
and its own bound, the greatest sketch hash in it.  The sketches of larger
items hold a smaller share of their hashes, so their bounds are low and few
shingles of a document are asked for; only the parts of the shortest items ask
for most.  Documents are probed part by part, for each width of shingles;
hits are candidates, and each candidate is confirmed by the exact containment
of the item's shingles, word by word, in the whole document.

Scale: the sketches are a few hashes per item; whether they are broadcast is
left to the planner, which knows their size.  A shingle that is in a third of
all documents gives one hit per document and item, no pairs of documents.

Defined results: words are runs of letters, marks and digits in lower case;
an item with fewer than ``shingle_words`` words is looked for as the one
sequence of its words; null or blank texts contain nothing and are never
items; equal items are reported each; a null item_id is kept as null; a null
doc_id names nothing and is left out by ``leaks``, while ``keep_clean`` judges
every row by its text; empty tables give empty results; other columns, whatever their
names, are ignored by ``leaks`` and pass through ``keep_clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS = 5
CONTAINMENT = (80, 100)
MISS = 1e-6


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _hashes(words: Column, width: int) -> Column:
    """Hashes of all shingles of ``width`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    found = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))))
    return F.when(F.size(words) >= width, found).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, width: int) -> Column:
    """The shingles themselves, as strings (words hold no blank)."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    found = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i + 1, width)))
    return F.when(F.size(words) >= width, found).otherwise(F.array().cast("array<string>"))


def sketch_size(n: int, containment: tuple[int, int] = CONTAINMENT, miss: float = MISS) -> int:
    """How many least hashes of an item of ``n`` shingles make it as good as sure
    that one of them is in a document that holds this share of the item: the
    chance that all fall on the shingles that may be missing."""
    part, whole = containment
    lacking = n - -(-n * part // whole)
    k, chance = 0, 1.0
    while chance > miss and k < n:
        chance *= max(0, lacking - k) / (n - k)
        k += 1
    return k


def part_sizes(containment: tuple[int, int] = CONTAINMENT, parts: int = 40) -> list[int]:
    """Sketch sizes of parts 0, 1, ...: the most that any size up to 2**p of the part
    asks for.  Beyond a few thousand shingles it does not change any more."""
    sizes = [max(sketch_size(n, containment) for n in range((1 << p >> 1) + 1, (1 << p) + 1)) for p in range(12)]
    far = max(sizes[-1], sketch_size(1 << 40, containment))
    return sizes + [far] * (parts - len(sizes))


def sketches(items: DataFrame, shingle_words: int = SHINGLE_WORDS, containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """(item_id, item, width, n, part, hash): the sketch of each item, a row per hash."""
    out = items.select("item_id", normal_words(items["text"]).alias("w")).filter(F.size("w") > 0)
    out = out.withColumn("width", F.least(F.size("w"), F.lit(shingle_words)))
    by_width = F.coalesce(*(F.when(F.col("width") == n, F.array_distinct(_hashes(F.col("w"), n))) for n in range(1, shingle_words + 1)))
    out = out.withColumns({"hashes": F.sort_array(by_width), "item": F.xxhash64("w")})
    out = out.withColumns({"n": F.size("hashes"), "part": F.when(F.size("hashes") > 1, F.length(F.bin(F.size("hashes").cast("long") - 1))).otherwise(0)})
    k = F.get(F.array(*(F.lit(x) for x in part_sizes(containment))), F.col("part"))
    return out.select("item_id", "item", "width", "n", "part", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))


def _probes(docs: DataFrame, key: str, bounds: list) -> DataFrame:
    """(key, width, part, hash): the shingles of documents that an item of that width and part may ask for."""
    words = docs.select(F.col(key), normal_words(docs["text"]).alias("w"))
    widths = sorted({b["width"] for b in bounds})
    words = words.select(key, *(_hashes(F.col("w"), w).alias(f"h{w}") for w in widths))
    each = [F.transform(F.filter(f"h{b['width']}", _at_most(b["top"])), _tagged(b["width"], b["part"])) for b in sorted(bounds, key=lambda b: (b["width"], b["part"]))]
    return words.select(key, F.explode(F.flatten(F.array(*each))).alias("p")).select(key, "p.width", "p.part", "p.hash")


def _at_most(top: int):
    return lambda h: h <= F.lit(top).cast("long")


def _tagged(width: int, part: int):
    return lambda h: F.struct(F.lit(width).alias("width"), F.lit(part).alias("part"), h.alias("hash"))


def _found(docs: DataFrame, key: str, items: DataFrame, shingle_words: int, containment: tuple[int, int]) -> DataFrame:
    """(key, item_id, n_shingles, n_shared) for contained items; ``key`` names rows of ``docs``."""
    sketched = common.materialize(sketches(items, shingle_words, containment), "leak-sketches")
    # One row per size partition and width: a few dozen at any size of the benchmark.
    bounds = sketched.groupBy("width", "part").agg(F.max("hash").alias("top")).collect()
    if not bounds:
        return docs.select(key, F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("n_shingles"), F.lit(0).alias("n_shared")).filter("false")
    hits = _probes(docs, key, bounds).join(sketched.select("width", "part", "hash", "item"), ["width", "part", "hash"])
    candidates = common.materialize(hits.select(key, "item").distinct(), "leak-candidates")
    wanted = items.select("item_id", normal_words(items["text"]).alias("iw")).filter(F.size("iw") > 0).withColumn("item", F.xxhash64("iw"))
    texts = docs.select(F.col(key), "text").join(candidates.select(key).distinct(), key).select(key, normal_words(F.col("text")).alias("w"))
    both = texts.join(candidates, key).join(wanted, "item").withColumn("width", F.least(F.size("iw"), F.lit(shingle_words)))
    mine = F.coalesce(*(F.when(F.col("width") == n, F.array_distinct(_shingles(F.col("iw"), n))) for n in range(1, shingle_words + 1)))
    theirs = F.coalesce(*(F.when(F.col("width") == n, _shingles(F.col("w"), n)) for n in range(1, shingle_words + 1)))
    counted = both.select(key, "item_id", mine.alias("mine"), theirs.alias("theirs"))
    counted = counted.select(key, "item_id", F.size("mine").alias("n_shingles"), F.size(F.array_intersect("mine", "theirs")).alias("n_shared"))
    part, whole = containment
    return counted.filter(F.col("n_shared") * whole >= F.col("n_shingles") * part)


def leaks(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS, containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): a row per document and contained item."""
    return _found(docs.select("doc_id", "text"), "doc_id", items, shingle_words, containment)


def keep_clean(docs: DataFrame, items: DataFrame, shingle_words: int = SHINGLE_WORDS, containment: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """Rows of ``docs`` that contain no item.  Rows are named by a digest of
    their text, so repeated rows are searched once each and fall together."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = _found(docs.select(digest.alias("digest"), "text"), "digest", items, shingle_words, containment).select("digest").distinct()
    # Names that no column of docs has, whatever its case.
    mine, theirs = common.unused(docs, "digest", 2)
    return docs.withColumn(mine, digest).join(found.withColumnRenamed("digest", theirs), F.col(mine) == F.col(theirs), "left_anti").drop(mine)
