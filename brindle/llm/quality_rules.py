"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule votes good (1) or bad (-1), or abstains (0).  The votes are counted
by pattern over all documents (two to the number of rules at most, whatever
the corpus), and expectation-maximisation on those counts estimates how
often each rule is right when it votes, and the share of good documents.  A document is kept if the posterior probability of good, given
its votes, is at least ``threshold`` and the two hard limits hold.

Everything is computed from whole texts row by row; the only shuffle is the
map-side combined count of patterns.

Defined results: null or blank text has no words, fails the hard limits and
is not kept; null ids pass through; repeated rows are judged each by itself;
an empty table gives an empty result; other columns are ignored by
``judge`` and pass through ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ROUNDS = 25
THRESHOLD = 0.5
_BLANK_FREE = r"[^\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of words that is found twice or more.

    Windows are compared by 64-bit hashes.  Only texts with a repeated window
    sort them; the union of the windows' words is then a sum over the gaps
    between their starts.
    """
    starts = F.sequence(F.lit(0), F.size(hashes) - window)
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(window))))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = _let(pairs, lambda p: F.filter(p, lambda a, j: F.coalesce(F.get(p, j - 1)["x"] == a["x"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["x"] == a["x"], F.lit(False))))
        at = F.sort_array(F.transform(again, lambda a: a["i"]))
        first = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(window), i - s["last"])).cast("long").alias("n"))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(F.aggregate(at, first, step, lambda s: s["n"]))

    return F.when(F.size(hashes) < window, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def features(docs: DataFrame) -> DataFrame:
    """Counts over each whole text, beside the columns of ``docs`` in ``row``."""
    text = F.coalesce(docs["text"], F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("t"), F.lit(pattern)).cast("long")
    out = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"), text.alias("t"), common.words(text).alias("w"))
    out = out.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(_BLANK_FREE)))
    return out.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).alias("n_repeat_words"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_loud"),
        count(r"\|").alias("n_bars"),
        count(r"\p{L}").alias("n_letters"),
    )


def votes() -> dict[str, Column]:
    """The rules.  Each compares counts, so a rule reads the same on any language.

    A rule that looks for a defect has nothing to say where it finds none, so
    it votes bad or abstains; prose and size look for the opposite.  Every
    kind of defect is looked for by two rules or more, without which EM could
    not tell a right lone vote from a wrong one.
    """
    n, chars = F.col("n_words"), F.col("word_chars")
    bad = lambda found: F.when(found, -1).otherwise(0)
    good = lambda found: F.when(found, 1).otherwise(0)
    spelled = (F.col("n_letters") * 100 >= 88 * chars) & (F.col("n_symbols") * 100 <= n)
    calm = (F.col("n_upper") * 8 <= chars) & (F.col("n_loud") * 20 <= n)
    fresh = (F.col("n_repeat_words") * 20 <= n) & (F.col("n_dup_lines") * 8 <= F.col("n_lines"))
    return {
        "symbols": bad(F.col("n_symbols") * 20 > n),
        "few_letters": bad(F.col("n_letters") * 100 < 80 * chars),
        "marked_up": bad((F.col("n_symbols") - F.col("n_bars")) * 6 > n),
        "tables": bad(F.col("n_bars") * 8 > n),
        "capitals": bad(F.col("n_upper") * 4 > chars),
        "loud": bad(F.col("n_loud") * 10 > n),
        "lines": bad(F.col("n_dup_lines") * 4 > F.col("n_lines")),
        "repeats": bad(F.col("n_repeat_words") * 10 > n),
        "word_length": bad((chars < 2 * n) | (chars > 14 * n)),
        "prose": good(spelled & calm & fresh & (n >= MIN_WORDS)),
        "size": good((n >= 60) & spelled & fresh),
    }


def fit(voted: DataFrame, rules: int, rounds: int = ROUNDS) -> dict:
    """EM over the counts of vote patterns in ``voted`` (column votes).

    Returns prior (share of good) and accuracy: how often each rule is right
    when it votes.  The starting point and ``lean`` pseudo-votes say that
    rules are right more often than not, which fixes which class is good.
    """
    lean, first = 10.0, 0.9
    counts = voted.groupBy("votes").agg(F.count("*").alias("n"))
    single = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    start = F.struct(F.lit(0.8).alias("prior"), F.array(*[F.lit(first)] * rules).alias("accuracy"))

    def odds(s: Column, v: Column) -> Column:
        terms = F.transform(v, lambda x, j: x * F.log(F.get(s["accuracy"], j) / (1 - F.get(s["accuracy"], j))))
        return F.aggregate(terms, F.log(s["prior"] / (1 - s["prior"])), lambda a, t: a + t)

    def maximise(w: Column) -> Column:
        total = lambda f: F.aggregate(w, F.lit(0.0), lambda a, x: a + f(x))

        def accuracy(j: int) -> Column:
            right = total(lambda x: F.when(x["v"][j] > 0, x["g"]).when(x["v"][j] < 0, x["b"]).otherwise(0.0))
            cast = total(lambda x: F.when(x["v"][j] != 0, x["g"] + x["b"]).otherwise(0.0))
            return F.least(F.lit(0.999), F.greatest(F.lit(0.55), (right + first * lean) / (cast + lean)))

        prior = (total(lambda x: x["g"]) + 0.8 * lean) / (total(lambda x: x["g"] + x["b"]) + lean)
        return F.struct(prior.alias("prior"), F.array(*(accuracy(j) for j in range(rules))).alias("accuracy"))

    def weigh(s: Column, x: Column) -> Column:
        good = 1 / (1 + F.exp(-odds(s, x["votes"])))
        return _let(good, lambda g: F.struct(x["votes"].alias("v"), (g * x["n"]).alias("g"), ((1 - g) * x["n"]).alias("b")))

    step = lambda s, i: _let(F.transform("p", lambda x: weigh(s, x)), lambda w: maximise(w))
    row = single.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("s")).first()
    return row["s"].asDict()


def judge(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """Counts, votes, posterior and verdict per row of ``docs``."""
    rules = votes()
    seen = common.materialize(features(docs).withColumn("votes", F.array(*rules.values())), "quality")
    model = fit(seen, len(rules), rounds)
    terms = [F.col("votes")[j] * math.log(a / (1 - a)) for j, a in enumerate(model["accuracy"])]
    odds = sum(terms, F.lit(math.log(model["prior"] / (1 - model["prior"]))))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = seen.withColumns({"posterior": 1 / (1 + F.exp(-odds)), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that are kept, with all their columns."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs["text"])
    return judge(whole, threshold).filter("kept").select("row.whole.*")


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns, and the posterior (to six places) behind the verdict."""
    return judge(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
