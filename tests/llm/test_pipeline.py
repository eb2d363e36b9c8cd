"""The pipeline, each stage against a brute-force version on its own input."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from brindle.llm import common, toxicity

from .test_free import brute_classes, expected_ids
from .test_native import WORD, brute_leaks, water_level

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_and_run(spark):
    docs = common.table(spark, SF, "documents")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_ids"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = (docs, common.materialize(stage(spark, docs, SF), name))
        docs = kept[name][1]
        assert docs.columns == kept[name][0].columns

    before, after = kept["toxicity"]
    scorer = toxicity.Scorer(toxicity.fit(before, common.table(spark, SF, "labels")))
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    scores = scorer([t for _, t in rows])
    assert ids(after) == sorted(i for (i, _), s in zip(rows, scores, strict=True) if s < 0.5)

    before, after = kept["near_dedup"]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert ids(after) == sorted(i for i, c in classes.items() if i == c)

    before, after = kept["decontamination"]
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    found = {k[0] for k in brute_leaks([(r["doc_id"], r["text"]) for r in before.collect()], items)}
    assert found and ids(after) == sorted(set(ids(before)) - found)

    before, after = kept["mixing"]
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in before.collect()}
    have, got = Counter(), Counter()
    for s, n in size.values():
        have[s] += n
    copies = Counter(ids(after))
    for i, k in copies.items():
        assert k <= 2
        got[size[i][0]] += k * size[i][1]
    for s, t in water_level(have, (5, 2, 1)).items():
        # A handful of documents a source: within its largest one.
        assert abs(got[s] - t) <= max(n for x, n in size.values() if x == s)

    mixed = sorted((r["doc_id"], r["text"]) for r in after.collect())
    want, at = [], 0
    for (i, _), e in zip(mixed, expected_ids([t for _, t in mixed]), strict=True):
        want.append((i, at, len(e), zlib.crc32(np.asarray(e, "<u4").tobytes())))
        at += len(e)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_take_empty_tables_and_nulls(spark):
    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "a", None)], docs.schema)
    for d, n in ((docs.limit(0), 0), (odd, None)):
        for _, stage in corpus_pipeline.STAGES:
            d = common.materialize(stage(spark, d, SF), "odd")
            assert n is None or d.count() == n


def test_stages_begin_with_a_collection_in_the_executors(spark):
    """Full collections of the JVM, which is driver and executor here."""
    def full():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = full()
        common.give_back(spark)
        alone = full() - before
        stage(spark, docs, SF)
        # Toxicity and near-dedup collect in the driver within as well, twice at most.
        assert full() - before > alone + 3, name
