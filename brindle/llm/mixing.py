"""Mixing sources to target weights, in DataFrame functions alone.

Method.  Every source gets a target number of words (weights, with a ceiling
of ``max_repeats`` times its size; the excess is shared again by weight).  A
source's documents of one number of words form a stratum, and a quota of so
many documents from a stratum is an exact number of words.  Whole copies of a
source come first; what its target still lacks is an even share of its strata
(running sums from the largest size down, rounded so that they never go over)
and then single documents, the largest that still fit.  Where more than half of
a source is lacking, those that stay out are picked in this way.  So a source
ends within its smallest document that was not picked, or none fits any more.

A splitting tree parts every source's number of draws among the output
shards: at each node the draws of each source that go left follow the
multivariate hypergeometric law (one exact hypergeometric draw after
another, given what is left), until every leaf holds one shard's quota.  The
draws of a source take permuted places (an affine bijection), of which each
shard owns a disjoint run as long as its quota; that says how many documents
of each stratum a shard draws.  The documents of a stratum, in an order by
hash, are dealt into a block per shard, as long as the shard's draws and its
share of the documents that stay, and a shard draws from its own block alone.
So the tree decides which documents are drawn, and no two shards can draw the
same.  Shards are shuffled locally.

Scale.  The text is shuffled once for the ranks and once for the shards.  A
stratum of more than ``HOT`` documents and of more than its share of all
(thousands of copies have one size) is hot and
dealt out by hashed salts; ranks over salts are sums of counts.  There are at
most ``HOT_STRATA`` such strata, so the list of them is broadcast.  Only tables
of (source, size) counts and of sources meet in few tasks.

Defined results: null text has size 0 and adds no words; null is a source of
its own and comes last; rows that repeat an id are told apart by their other
columns, and rows equal in all of them are interchangeable;
an empty table gives an empty mix; if all sizes are 0 all targets are 0;
columns of any other name pass through; ``shards`` must be a power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SHARDS = 16
SEED = 20240607
SALTS = 256
#: Sources that a row of the tree holds, about, and points drawn at most for one number.
GROUP, TRIES = 4096, 100
#: Strata of more documents than this, and than this share of all, are hot.
HOT, HOT_STRATA = 1000, 4096
#: Places are counted in runs of so many.
RUN = 1 << 16
# Fixed primes near a million, one of which is coprime to any number of draws in practice.
_PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099)


def _long(value) -> Column:
    return F.lit(value).cast("long")


def _log_factorials(*ns: Column) -> Column:
    """log of the product of n!, each by Stirling's series, shifted up by eight so
    that small n are exact to 1e-12."""

    def one(x: Column) -> Column:
        y = 1 / (x * x)
        product = x - 8
        for i in range(1, 8):
            product = product * (x - i)
        return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y / 1260)) / x - F.log(product)

    return F.aggregate(F.array(*(n + 9.0 for n in ns)), F.lit(0.0), lambda s, x: s + one(x))


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*parts), _long(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` fall on ``good``, by chance that is
    fixed by ``u``.

    Ratio of uniforms: points are drawn from a hat around the law until one is
    under it, so the law is exact and the work does not grow with the numbers.
    More than half of the points are taken; after ``TRIES``, once in 1e20 or
    less, the most likely number is."""
    given = F.struct(good.cast("double").alias("g"), total.cast("double").alias("n"), draws.cast("double").alias("k"), u.alias("u"))
    return _let(given, _drawn)


def _drawn(given: Column) -> Column:
    g, n, k = given["g"], given["n"], given["k"]
    share = F.when(n > 0, g / n).otherwise(0.0)
    spread = F.sqrt(F.when(n > 1, k * share * (1 - share) * (n - k) / (n - 1)).otherwise(0.0) + 0.5)
    low, high = F.greatest(F.lit(0.0), k - (n - g)), F.least(g, k)
    mode = F.least(high, F.greatest(low, F.floor((k + 1) * (g + 1) / (n + 2)).cast("double")))

    def log_mass(v: Column) -> Column:
        return -_log_factorials(v, g - v, k - v, n - g - k + v)

    def search(m: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            a, b = _unit(given["u"], i), _unit(given["u"], i, F.lit(1))
            return F.when(s.isNotNull(), s).otherwise(_let(F.struct(a.alias("a"), F.floor(m["middle"] + m["width"] * (b - 0.5) / a).cast("double").alias("v")), under))

        def under(p: Column) -> Column:
            inside = (p["v"] >= m["low"]) & (p["v"] <= m["high"])
            return F.when(inside & F.when(inside, 2 * F.log(p["a"]) <= log_mass(p["v"]) - m["peak"]).otherwise(False), p["v"].cast("long"))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("long"), step)
        return F.when(m["low"] >= m["high"], m["low"].cast("long")).otherwise(F.coalesce(found, m["mode"].cast("long")))

    # The hat's width: 2 sqrt(2 / e) deviations and 3 - 2 sqrt(3 / e).
    facts = F.struct(low.alias("low"), high.alias("high"), mode.alias("mode"), (k * share + 0.5).alias("middle"), (1.7155277699214135 * spread + 0.8989161620588988).alias("width"), _let(mode, log_mass).alias("peak"))
    return _let(facts, search)


def _sized(docs: DataFrame, seed: int, carry: list[str]) -> DataFrame:
    plain = [c.name for c in docs.schema if "map<" not in c.dataType.simpleString()]
    return docs.select(
        F.struct(*(docs[c] for c in carry)).alias("row"),
        F.when(docs["source"].isNull(), "n").otherwise(F.concat(F.lit("s"), docs["source"])).alias("src"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(docs["doc_id"], docs["text"], F.lit(seed)).alias("h"), F.xxhash64(*(docs[c] for c in plain)).alias("tie"),
    ).withColumn("salt", F.pmod("h", _long(SALTS)))


def source_targets(sources: DataFrame, weights: tuple, share: float, max_repeats: int) -> DataFrame:
    """Targets of sources (src, words): the level at which the weights, cut at the
    ceilings, use up the whole budget."""
    # One row per source: these windows see no documents.
    order = Window.orderBy(F.when(F.col("src") == "n", 1).otherwise(0), "src")
    picked = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sources.withColumn("weight", picked)
    out = out.withColumn("ratio", max_repeats * F.col("words") / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    budget = share * F.sum("words").over(every)
    capped = max_repeats * F.coalesce(F.sum("words").over(before), _long(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", (budget - capped) / left)
    out = out.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"])
    ceiling = (max_repeats * F.col("words")).cast("double")
    return out.withColumn("target", F.least(ceiling, F.coalesce(F.col("level") * F.col("weight"), ceiling))).drop("level", "ratio")


def _quotas(hist: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """(src, size, n, base, k, stratum_at, extra_at and the source's facts): whole
    copies of the source, and how many documents of each size are drawn once more.

    ``targets`` has a row per source (src, words, docs, target)."""
    out = targets.withColumn("base", F.when(F.col("words") > 0, F.least(_long(max_repeats), F.floor(F.col("target") / F.col("words")))).otherwise(_long(0)))
    out = out.withColumn("rest", F.when(F.col("base") < max_repeats, F.col("target") - F.col("base") * F.col("words")).otherwise(0.0))
    # Where more than half are wanted, those that are left out are picked instead.
    out = out.withColumn("flip", 2 * F.col("rest") > F.col("words"))
    out = out.withColumn("goal", F.when(F.col("flip"), F.greatest(F.lit(0.0), F.col("words") - F.col("rest"))).otherwise(F.col("rest")))
    out = out.withColumn("rate", F.when(F.col("words") > 0, F.col("goal") / F.col("words")).otherwise(0.0))
    # Sizes of a source, largest first: every 1/rate-th document, the smaller end of each run of that many.
    down = Window.partitionBy("src").orderBy(F.desc("size"))
    before = lambda c: F.coalesce(F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, -1)), _long(0))
    out = hist.join(out, "src").withColumn("stratum_at", before("n"))
    out = out.withColumn("even", F.when(F.col("size") > 0, F.least("n", F.floor((F.col("stratum_at") + F.col("n")) * F.col("rate")) - F.floor(F.col("stratum_at") * F.col("rate")))).otherwise(_long(0)))
    strata = common.materialize(out, "mix-strata")
    # What that leaves is filled by single documents, largest first.  Between two
    # sizes that do not fit whole, what is lacking halves, so a few runs say it all.
    sizes = strata.filter("size > 0").groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("size", (F.col("n") - F.col("even")).alias("left"))), asc=False).alias("sizes"),
        (F.max("goal") - F.sum(F.col("even") * F.col("size"))).alias("lack"),
    )
    runs = "array<struct<top:bigint,bottom:bigint,k:bigint>>"
    first = F.struct(F.col("lack"), F.lit(None).cast("long").alias("top"), F.array().cast(runs).alias("runs"))

    def step(s: Column, x: Column) -> Column:
        fits = F.greatest(_long(0), F.floor(s["lack"] / x["size"] + 1e-9))
        take = F.least(fits, x["left"])
        whole = take == x["left"]
        end = F.struct(F.coalesce(s["top"], x["size"]).alias("top"), x["size"].alias("bottom"), take.alias("k"))
        top = F.when(whole, F.coalesce(s["top"], x["size"]))
        ended = F.when(~whole & (s["top"].isNotNull() | (take > 0)), F.concat(s["runs"], F.array(end))).otherwise(s["runs"])
        return F.struct((s["lack"] - take * x["size"]).alias("lack"), top.alias("top"), ended.alias("runs"))

    def closed(s: Column) -> Column:
        last = F.struct(s["top"].alias("top"), _long(0).alias("bottom"), _long(0).alias("k"))
        return F.when(s["top"].isNotNull(), F.concat(s["runs"], F.array(last))).otherwise(s["runs"])

    runs = sizes.select("src", F.aggregate("sizes", first, step, closed).alias("runs"))
    mine = F.filter("runs", lambda r: (r["top"] >= F.col("size")) & (r["bottom"] <= F.col("size")))
    more = _let(mine, lambda m: F.when(F.size(m) == 0, _long(0)).when(m[0]["bottom"] == F.col("size"), m[0]["k"]).otherwise(F.col("n") - F.col("even")))
    out = strata.join(runs, "src", "left").withColumn("k", F.col("even") + F.when((F.col("size") > 0) & F.col("runs").isNotNull(), more).otherwise(_long(0)))
    out = out.withColumn("k", F.when(F.col("flip") & (F.col("size") > 0), F.col("n") - F.col("k")).otherwise(F.col("k")))
    out = out.withColumn("extra_at", before("k")).drop("runs", "even", "rest", "goal", "rate", "flip")
    return common.materialize(out, "mix-quotas")


def _split(counts: str, room: Column, *names: Column) -> Column:
    """What of each of ``counts`` goes left, if ``room`` draws do: one hypergeometric
    draw after another, given what is left."""
    first = F.struct(F.aggregate(counts, _long(0), lambda s, x: s + x).alias("total"), room.alias("room"), _long(0).alias("i"), F.array().cast("array<bigint>").alias("left"))

    def step(s: Column, x: Column) -> Column:
        got = hypergeometric(x, s["total"], s["room"], _unit(*names, s["i"]))
        return F.struct((s["total"] - x).alias("total"), (s["room"] - got).alias("room"), (s["i"] + 1).alias("i"), F.concat(s["left"], F.array(got)).alias("left"))

    return F.aggregate(counts, first, step, lambda s: s["left"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, ends): the draws of each source parted among shards, as running ends.

    ``quotas`` has (src, draws); ``shards`` is a power of two.  The halves of a
    node take draws as even as can be.  A row of a node holds about ``GROUP``
    sources; where there are more, what goes left is parted first among the rows
    and then inside each, which is the same law.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    groups = max(1, -(-quotas.count() // GROUP))
    node = quotas.groupBy(F.pmod(F.xxhash64("src"), _long(groups)).alias("group")).agg(F.sort_array(F.collect_list(F.struct("src", "draws"))).alias("q"))
    node = node.select(_long(0).alias("node"), "group", F.transform("q", lambda x: x["src"]).alias("srcs"), F.transform("q", lambda x: x["draws"]).alias("q"))
    half = lambda counts: F.expr(f"(aggregate({counts}, 0L, (s, x) -> s + x) + 1) div 2")
    level, width = 0, shards
    while width > 1:
        room = half("q")
        if groups > 1:
            node = common.materialize(node, "mix-tree")
            whole = node.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("group", F.aggregate("q", _long(0), lambda s, x: s + x).alias("n")))).alias("a"))
            whole = whole.select("node", F.transform("a", lambda x: x["group"]).alias("groups"), F.transform("a", lambda x: x["n"]).alias("counts"))
            whole = whole.withColumn("left", _split("counts", half("counts"), F.lit(seed), F.lit(level), F.col("node")))
            rooms = whole.select("node", F.explode(F.arrays_zip("groups", "left")).alias("x")).select("node", F.col("x.groups").alias("group"), F.col("x.left").alias("room"))
            node, room = node.join(rooms, ["node", "group"]), F.col("room")
        node = node.withColumn("left", _split("q", room, F.lit(seed), F.lit(level), F.col("node"), F.col("group")))
        node = node.select("group", "srcs", F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
        )).alias("child")).select("child.node", "group", "srcs", "child.q")
        level, width = level + 1, width // 2
    leaves = node.select("node", F.explode(F.arrays_zip("srcs", "q")).alias("x")).select("node", F.col("x.srcs").alias("src"), F.col("x.q").alias("q"))
    running = leaves.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("node", "q"))).alias("a"))
    return running.select("src", F.transform("a", lambda x: F.aggregate(F.filter("a", lambda y: y["node"] <= x["node"]), _long(0), lambda s, y: s + y["q"])).alias("ends"))


def _shard_of(place: Column) -> Column:
    """The shard that owns a place: the number of runs that end before it."""
    return F.size(F.filter("ends", lambda e: e <= place))


def _place(p: Column) -> Column:
    """The permuted place of a source's p-th draw."""
    total = F.greatest(F.col("source_draws"), _long(1))
    return F.pmod(F.pmod(p, total) * F.col("step") + F.col("shift"), total)


def _blocks(strata: DataFrame, facts: DataFrame, shards: int) -> DataFrame:
    """(src, size, drawn, starts): how many documents of a stratum each shard draws,
    and where its block of the stratum's documents starts."""
    some = strata.filter("k > 0").select("src", "size", "k", "extra_at")
    runs = some.select("*", F.explode(F.sequence(_long(0), F.col("k") - 1, _long(RUN))).alias("from"))
    runs = runs.repartition("src", "size", "from").join(facts, "src")
    drawn = runs.withColumn("t", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN, F.col("k")) - 1)))
    drawn = drawn.select("src", "size", _shard_of(_place(F.col("base") * F.col("docs") + F.col("extra_at") + F.col("t"))).alias("shard"))
    drawn = drawn.groupBy("src", "size", "shard").agg(F.count("*").alias("m")).groupBy("src", "size").agg(F.map_from_entries(F.collect_list(F.struct("shard", "m"))).alias("m"))
    out = strata.select("src", "size", "n", "k").join(drawn, ["src", "size"]).join(facts.select("src", "ends", "source_draws"), "src")
    out = out.withColumn("drawn", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.coalesce(F.try_element_at("m", j), _long(0))))
    # A block holds the shard's draws and its share of the documents that stay.
    def start(j: Column) -> Column:
        before = F.aggregate(F.slice("drawn", F.lit(1), j), _long(0), lambda a, x: a + x)
        return before + F.when(j > 0, F.floor((F.col("n") - F.col("k")) * (F.get("ends", j - 1) / F.col("source_draws")))).otherwise(_long(0))

    out = out.withColumn("starts", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), start))
    return common.materialize(out.select("src", "size", "drawn", "starts"), "mix-blocks")


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, shards: int = SHARDS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: row (its columns, or those of ``carry``), size, source_size,
    target, and ``draws``: an array of (shard, place) with one entry per copy taken."""
    common.give_back(docs.sparkSession)
    sized = _sized(docs, seed, docs.columns if carry is None else carry)
    counts = common.materialize(sized.groupBy("src", "size", "salt").agg(F.count("*").alias("n")), "mix-counts")
    hist = common.materialize(counts.groupBy("src", "size").agg(F.sum("n").alias("n")), "mix-sizes")
    per_source = common.materialize(hist.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs")), "mix-sums")
    targets = source_targets(per_source, weights, share, max_repeats).select("src", "words", "docs", "target")
    strata = _quotas(hist, targets, max_repeats)
    sources = strata.groupBy("src").agg(
        F.max("base").alias("base"), F.max("words").alias("source_size"), F.max("target").alias("target"), F.max("docs").alias("docs"),
        (F.max(F.col("base") * F.col("docs")) + F.sum("k")).alias("source_draws"),
    )
    sources = common.materialize(sources, "mix-sources")
    ends = splitting_tree(sources.select("src", F.col("source_draws").alias("draws")), shards, seed)
    q = F.col("source_draws")
    step = F.lit(1)
    for p in reversed(_PRIMES):
        step = F.when(F.pmod(F.lit(p), F.greatest(q, _long(1))) == 0, step).otherwise(F.when(F.pmod(q, F.lit(p)) != 0, F.lit(p)).otherwise(step))
    facts = sources.join(ends, "src").withColumns({"step": step.cast("long"), "shift": F.pmod(F.xxhash64("src", F.lit(seed)), F.greatest(q, _long(1)))})
    facts = common.materialize(facts, "mix-facts")
    blocks = _blocks(strata, facts, shards)
    # Hot strata, of which there are at most HOT_STRATA, are known before documents meet by stratum.
    least = max(HOT, (hist.agg(F.sum("n")).first()[0] or 0) // HOT_STRATA)
    hot = hist.filter(F.col("n") > least).select(F.col("src").alias("hot_src"), F.col("size").alias("hot_size"))
    dealt = lambda df: df.join(F.broadcast(hot), (F.col("src") == F.col("hot_src")) & (F.col("size") == F.col("hot_size")), "left").withColumn(
        "salt", F.when(F.col("hot_src").isNotNull(), F.col("salt")).otherwise(_long(-1))).drop("hot_src", "hot_size")
    # A row per stratum, and for hot ones a row per salt with the documents of the salts before.
    over_salts = Window.partitionBy("src", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = dealt(counts).groupBy("src", "size", "salt").agg(F.sum("n").alias("n"))
    salted = salted.withColumn("salt_at", F.coalesce(F.sum("n").over(over_salts), _long(0))).drop("n")
    salted = salted.join(strata.select("src", "size", "stratum_at"), ["src", "size"]).join(blocks, ["src", "size"], "left")
    salted = common.materialize(salted, "mix-plan")
    ranked = dealt(sized).withColumn("nth", (F.row_number().over(Window.partitionBy("src", "size", "salt").orderBy("h", "tie")) - 1).cast("long"))
    # Rows are dealt by these keys for their ranks already, so the table need not go to every task.
    ranked = ranked.join(salted.hint("merge"), ["src", "size", "salt"]).join(facts, "src")
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("salt_at"))
    whole = F.transform(F.filter(F.sequence(_long(0), _long(max_repeats - 1)), lambda e: e < F.col("base")), lambda e: _place(e * F.col("docs") + F.col("stratum_at") + F.col("rank")))
    copies = F.transform(whole, lambda p: F.struct(_shard_of(p).cast("int").alias("shard"), F.xxhash64(p, "src", F.lit(seed)).alias("place")))
    # The block that a document falls in is the last that starts at or before its rank.
    block = F.size(F.filter("starts", lambda a: a <= F.col("rank"))) - 1
    extra = F.struct(block.cast("int").alias("shard"), F.xxhash64("h", "tie", F.lit(seed)).alias("place"))
    in_block = _let(block, lambda b: F.col("rank") - F.get("starts", b) < F.get("drawn", b))
    draws = F.when(F.col("starts").isNotNull() & in_block, F.concat(copies, F.array(extra))).otherwise(copies)
    return ranked.select("row", "size", "source_size", "target", draws.alias("draws"))


def mix(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """The mixed documents themselves: columns of ``docs``, a row per copy.

    A shard is dealt out in slices of its permuted places, as many as the
    session's shuffle partitions ask for, and each slice is shuffled inside.
    """
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = 8 * -(-parts // shards)
    drawn = plan(docs, shards=shards, **options).select("row", F.explode("draws").alias("draw"))
    dealt = drawn.repartition(parts, F.col("draw.shard"), F.pmod("draw.place", _long(slices)))
    return dealt.sortWithinPartitions("draw.shard", "draw.place").select("row.*")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document what the mix takes of it (the contract's columns)."""
    return plan(docs.select("doc_id", "source", "text"), carry=["doc_id"], **options).select(
        "row.doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"))
