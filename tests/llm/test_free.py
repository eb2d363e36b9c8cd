"""The other operators: 1, 3, 4, 6, 9, 10."""

import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import components, neardup, quality_knn, secrets, tokens, toxicity, warc
from brindle.llm.common import new_path
from brindle.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, None, None, None, *x) for i, t, *x in rows], DOCS + extra)


# Near duplicates.


def brute_classes(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    for n, (i, s) in enumerate(flat):
        for j, t in flat[:n]:
            k = len(s & t)
            if 100 * k >= 80 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_brute_force(spark, width):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(140)]
    rows = []
    for i in range(260):  # copies with more and more edits: many pairs near the threshold
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60)))) for i in range(120)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "oNE\x0b"), (2005, "one two"), (2006, "ÄB c"), (2007, "äB c"), (2008, rows[0][1].upper()), (5, rows[5][1]), (2009, "w1 " * 20000), (2010, "w1 " * 30000)]
    want = brute_classes(rows, width)
    d = docs(spark, [(*x, 0, 0) for x in rows] + [(None, "null id text", 0, 0)], ", component_id int, node int").repartition(6)
    got = neardup.classify(d, width).collect()
    assert len(got) == len(rows) + 1
    for g in got:
        assert g["component_id"] == (want[g["doc_id"]] if g["doc_id"] is not None else None), g
    kept = neardup.keep_one(d, width)
    assert kept.columns == d.columns
    assert Counter(k["doc_id"] for k in kept.collect()) == Counter([None, *{i for i, c in want.items() if i == c}])


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    r = random.Random(9)
    text = [" ".join(r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(60)) for _ in range(4)]
    rows = [(7, text[0]), (7, text[1]), (3, text[0]), (7, text[2]), (7, text[2]), (9, text[3]), (8, text[3] + " x"), (None, text[3]), (7, None)]
    got = Counter((k["doc_id"], k["text"]) for k in neardup.keep_one(docs(spark, rows)).collect())
    assert got == Counter([(7, text[1]), (3, text[0]), (7, text[2]), (8, text[3] + " x"), (None, text[3]), (7, None)])


def test_rows_of_one_id_link_by_each_of_their_texts(spark):
    """An id with a short and a long text is linked through either."""
    r = random.Random(10)
    text = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(999)) for _ in range(n))
    short, long = text(40), text(900)
    rows = [(5, long), (5, short), (7, short + " x"), (8, long + " y"), (9, text(40)), (3, text(300)), (3, short + " z")]
    want = brute_classes(rows, 2)
    got = {g["doc_id"]: g["component_id"] for g in neardup.classify(docs(spark, rows), 2).collect()}
    assert got == want and got[7] == got[8] == got[5] == 3


def test_texts_that_no_pair_names_are_not_moved(spark):
    """Without joins by broadcast, only the texts of candidates may be shuffled, not all in each round."""
    r = random.Random(12)
    text = lambda: " ".join(f"{r.getrandbits(64):x}" for _ in range(2000))
    rows = [(i, text()) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " x") for i in range(8)] + [(-1, rows[30][1] + " y"), (-2, rows[30][1])]
    d = docs(spark, rows).localCheckpoint()
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def stages() -> dict:
        none = jvm.java.util.ArrayList()
        found = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    key = "spark.sql.autoBroadcastJoinThreshold"
    threshold, before = spark.conf.get(key), set(stages())
    spark.conf.set(key, "-1")
    try:
        got = {g["doc_id"]: g["component_id"] for g in neardup.classify(d, 2).collect()}
    finally:
        spark.conf.set(key, threshold)
    context.listenerBus().waitUntilEmpty()
    assert all(got[1000 + i] == i for i in range(8)) and got[30] == got[-1] == got[-2] == -2 and len(set(got.values())) == 400
    moved = sum(n for i, n in stages().items() if i not in before)
    assert moved < sum(len(t) for _, t in rows) / 4, moved


@pytest.mark.parametrize("most", [1 << 15, 1 << 26])
def test_bitmaps_of_ids_lose_none(spark, monkeypatch, most):
    """Every row of a named id passes, however full the bitmap; of the others few where it has room."""
    monkeypatch.setattr(neardup, "MOST_BITS", most)
    ids = [*range(-3000, 3000, 3), -(1 << 63), (1 << 63) - 1]
    named = spark.createDataFrame([(i,) for i in ids] * 2 + [(None,)], "b bigint")
    texts = spark.createDataFrame([(i, f"{i} {k}") for i in {*ids, *range(-3000, 9000)} for k in range(2)], "doc_id bigint, text string")
    got = Counter((g["b"], g["text"]) for g in neardup._texts_of(texts, named, "b", 2 * len(ids) + 1).collect())
    assert set(got.values()) == {1} and {(i, f"{i} {k}") for i in ids for k in range(2)} <= set(got)
    assert len(got) - 2 * len(ids) < 20000 / (5 if most > 1 << 15 else 8)


def test_neardup_of_nothing(spark):
    assert neardup.contract(docs(spark, [])).count() == 0
    one = neardup.contract(docs(spark, [(1, None), (2, None)])).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in one} == {(1, 0, 1, True), (2, 0, 2, True)}


KEPT_BY_A_WORKER = """
import re
import pyarrow as pa
from brindle.llm import neardup

def private():
    return int(re.search("Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():
    texts = [" ".join(f"word{(i * j) % 5000}" for j in range(400)) for i in range(12000)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(12000)), pa.array(texts)], names=["doc_id", "text"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, whole.schema) as w:
        w.write_batch(whole)
    yield from pa.ipc.open_stream(out.getvalue())

sign = neardup._signer(5, 32, 5)
for _ in sign(iter([])):
    pass
before, n = private(), 0
for run in sign(batches()):
    n += len(run)
del run
print(n, private() - before)
"""


def test_a_worker_gives_memory_back_at_the_end_of_its_task():
    """Workers stay between tasks: of a batch of 40 MB they must not keep most."""
    ran = subprocess.run([sys.executable, "-c", KEPT_BY_A_WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=120)
    n, kept = ran.stdout.split()
    assert int(n) == 12000 and float(kept) < 40


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    """Texts of 24 MB in one partition are not one batch; the session's setting stays as it was."""
    sign = neardup._signer

    def watched(*a):
        run = sign(*a)

        def checked(batches):
            for b in batches:
                assert b.nbytes < 6 << 20, f"a batch of {b.nbytes} bytes"
                yield from run(iter([b]))

        return checked

    monkeypatch.setattr(neardup, "_signer", watched)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("n"), "id", F.repeat(F.concat(F.lit(" w"), "id"), 15000)).alias("text")).coalesce(1)
    got = neardup.classify(d).collect()
    assert len(got) == 400 and all(g["component_id"] == g["doc_id"] for g in got)
    assert spark.conf.get(key, None) is None


def test_components_of_a_long_chain(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(900, 901), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(n)} == {0} and got[901] == 900
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_take_few_steps(spark, monkeypatch):
    """A sorted chain, a star whose middle is the greatest, and a chain of small and great nodes in turn."""
    made = Counter()
    plain = components.common.materialize
    monkeypatch.setattr(components.common, "materialize", lambda df, tag: made.update([tag]) or plain(df, tag))
    n = 1000
    chain = [(i, i + 1) for i in range(n - 1)]
    star = [(5000 + n, 5000 + i) for i in range(n)]
    turns = [(10_000 + i // 2 + (i % 2) * n, 10_000 + (i + 1) // 2 + ((i + 1) % 2) * n) for i in range(n)]
    for edges in (chain, star, turns):
        made.clear()
        got = {r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").coalesce(1)).collect()}
        assert got == {min(map(min, edges))} and made["cc-step"] <= 3 and made["cc-jump"] <= 12, made


def test_hot_hubs_are_dealt_over_buckets(spark, monkeypatch):
    """Links inside a hub's group are the same however small the blocks and however many the buckets."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    core = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(150):  # a common part and a part of each text's own, near the threshold in both directions
        own = [r.choice(vocabulary) for _ in range(r.choice([4, 8, 12, 16]))]
        rows.append((i, " ".join(core + own + (rows[-1][1].split()[60:] if i % 3 == 1 else []))))
    want = brute_classes(rows, 2)
    for sizes in ((256, 1024, 1 << 18, 1 << 20, 64), (5, 9, 1 << 18, 1 << 20, 3), (256, 1024, 300, 500, 1)):
        for name, value in zip(("LEFT", "RIGHT", "LEFT_SHINGLES", "RIGHT_SHINGLES", "BUCKETS"), sizes, strict=True):
            monkeypatch.setattr(neardup, name, value)
        got = {g["doc_id"]: g["component_id"] for g in neardup.classify(docs(spark, rows), 2).collect()}
        assert got == want


# Token files.

ODD = ["a\x1cb c d", "<|endoftext|> x<|endoftext|>y", "Σίσυφος ΣΑΣ Ss", "don't I'LL  you'vé e ́x", " x\u0085y", "", " \n", None, "ﬁ İstanbul ǅ ŉa Ĳs", "a" * 5000, "123 4-5 ..!?", "Émile''s é́ Å ſs", "x<|endoftext|> é<|startoftext|>,", "word\x0bword"]


def expected_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*e.ids, 2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_batch_tokenizer_equals_the_library():
    ids, counts = tokens.BatchTokenizer(tokenizer_path(), 2)(pa.array(ODD))
    for got, want in zip(np.split(ids, np.cumsum(counts)[:-1]), expected_ids(ODD), strict=True):
        assert got.tolist() == want.tolist()


def test_segments_give_any_id():
    g = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 200), (511, 300), (512, 70000), (5000, 1 << 24)):
        ids = g.integers(0, top, n).astype(np.uint32)
        s = tokens.Segment(tokens.encode_segment(ids, np.array([n // 2, n])))
        assert len(s) == n and (s.ids() == ids).all() and all(s[i] == ids[i] for i in range(n))
        assert s.document(1).tolist() == ids[n // 2 :].tolist()
        for a, b in g.integers(0, n + 1, (40, 2)) if n else []:
            assert s.span(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()
        with pytest.raises(IndexError):
            s[n]


def test_token_files_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 50)
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD)] + [(4, "again"), (None, "null id"), (-5, "first")]
    d = docs(spark, [(*r, 1) for r in rows], ", start int").repartition(3)
    got = tokens.encode_documents(d, new_path(spark, "t"), tokenizer_path()).collect()
    assert len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: -99 if k is None else k)
    want = Counter((i, len(e), zlib.crc32(e.tobytes())) for (i, _), e in zip(rows, expected_ids([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert tokens.encode_documents(d.limit(0), new_path(spark, "t"), tokenizer_path()).count() == 0


def test_tokens_by_corpus_position(spark, monkeypatch):
    """Any id of the corpus by its place alone, over segments, parts and a document longer than a segment."""
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 50)
    rows = [(i, t) for i, t in enumerate([*ODD, *ODD])]
    d, path = docs(spark, rows).repartition(3), new_path(spark, "t")
    tokens.write_files(d, path, tokenizer_path())
    ids = np.concatenate(expected_ids([t for _, t in rows])).tolist()
    starts = sorted((r["part"], r["seq"], r["n_ids"], r["at"]) for r in tokens.segment_starts(spark, path).collect())
    assert len({s[0] for s in starts}) > 1 and [s[3] for s in starts] == [sum(x[2] for x in starts[:k]) for k in range(len(starts))]
    asked = spark.createDataFrame([(p,) for p in [*range(len(ids)), 5, 5, -1, len(ids), 10**12, None]], "position bigint")
    got = {r["position"]: r["token_id"] for r in tokens.tokens_at(spark, path, asked).collect()}
    assert got == dict(enumerate(ids))
    tokens.write_files(d.limit(0), empty := new_path(spark, "t"), tokenizer_path())
    assert tokens.tokens_at(spark, empty, asked).count() == 0


# Secrets.


def test_base_spans_against_plain_patterns():
    r = random.Random(2)
    parts = ["password", "PassWd", "api_key", "APIKEY", "ſecret", "token", '"', "'", " ", ":", "=", "AKIA", "AKIAABCDEFGHIJKLMN", "abcdef0123456789", "0" * 40, "Zz9+/_.=-", "é", "\n", "secret: ", "longvalue12345"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 12)))
        want = [("assign", *m.span()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert [s for s in secrets.scan_text(text) if s[0] != "random"] == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


NATURAL = (
    "Donaudampfschifffahrtsgesellschaft", "/usr/share/doc/python/examples/README", "DE89370400440532013000", "thenquickbrownfoxjumpsoverthelazydog",
    "CamelCaseNamesAreLongInJavaPrograms2", "2024-01-02T03-04-05-000000", "aaaaaaaaaaaaaaaaaaaaaaaaaaAAAAAAAA11", "550e8400-e29b-41d4-a716-446655440000",
    "SCREAMING_SNAKE_CASE_CONSTANT_NAME", "very-long-url-slug-with-many-words-in-it-2024", "keitstlichschenverpfandung", "internationalization-and-localization", "00000000000000000000000000", "92834759283475983475983475",
)


@pytest.mark.parametrize("length", [20, 24, 32, 40, 64])
def test_battery_finds_random_draws_of_every_encoding(length):
    r = random.Random(length)
    for name, alphabet in secrets.ENCODINGS.items():
        found = 0
        for _ in range(200):
            text = "see " + "".join(r.choice(alphabet) for _ in range(length)) + " there"
            found += any(s[1] <= 4 and s[2] >= 4 + length for s in secrets.scan_text(text))
        # Letters of one case alone are far from text only when there are more of them.
        assert found >= (200 * 0.55 if name in ("letters", "LETTERS") and length < 32 else 200 * 0.88), (name, length, found)


def test_battery_leaves_natural():
    for natural in NATURAL:
        assert not [s for s in secrets.scan_text(f"x {natural} y") if s[0] == "random"], natural


def test_battery_against_plain_statistics():
    """The uniform tests written out with loops."""
    r = random.Random(3)
    for name in ("hex", "base62", "LETTERS"):
        alphabet = secrets.ENCODINGS[name]
        for n in (20, 33, 80):
            run = "".join(r.choice(alphabet) for _ in range(n))
            at = [alphabet.index(c) for c in run]
            k = max(3, min(len(alphabet), n // 5))
            tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
            wilson = lambda chi, f: tail(((chi / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f)))
            band = lambda i: int(i * k / len(alphabet))
            share = [sum(band(i) == j for i in range(len(alphabet))) / len(alphabet) for j in range(k)]
            ps = [wilson(sum((sum(band(i) == j for i in at) - n * q) ** 2 / (n * q) for j, q in enumerate(share)), k - 1)]
            kinds = [q for q in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if any(c in q for c in alphabet)]
            if len(kinds) > 1:
                want = [n * sum(c in q for c in alphabet) / len(alphabet) for q in kinds]
                ps.append(wilson(sum((sum(c in q for c in run) - e) ** 2 / e for q, e in zip(kinds, want, strict=True)), len(kinds) - 1))
            high = [i >= len(alphabet) / 2 for i in at]
            a, b = sum(high), n - sum(high)
            m = 1 + 2 * a * b / n
            ps.append(2 * tail(abs(1 + sum(x != y for x, y in zip(high, high[1:])) - m) / math.sqrt((m - 1) * (m - 2) / (n - 1))))
            mean = sum(at) / n
            ps.append(2 * tail(abs(sum((x - mean) * (y - mean) for x, y in zip(at, at[1:])) / sum((x - mean) ** 2 for x in at)) * math.sqrt(n)))
            assert secrets.randomness(run, alphabet) == pytest.approx(min(1.0, 4 * min(ps)))


def test_false_finds_are_controlled_over_the_corpus(spark):
    """What one text by itself would list is left out where a corpus tests thousands of natural runs."""
    r = random.Random(5)
    syllables = ["ver", "lich", "keit", "heit", "ung", "schaft", "ein", "be", "er", "tion", "ment", "elle", "que", "aux"]
    natural = [(i, "Ein " + "".join(r.choice(syllables) for _ in range(r.randrange(5, 9))).ljust(20, "n") + " Wort") for i in range(3000)]
    strong = "".join(r.choice(secrets.ENCODINGS["base62"]) for _ in range(64))
    alone = sum(any(k == "random" for k, *_ in secrets.scan_text(t)) for _, t in natural)
    got = {x["doc_id"]: x["spans"] for x in secrets.scan(docs(spark, [*natural, (9000, f"see {strong} there")])).collect()}
    found = [i for i, spans in got.items() if any(s["kind"] == "random" for s in spans)]
    assert 9000 in found and len(found) - 1 <= max(1, alone // 10), (alone, len(found))


def test_cuts_are_those_of_benjamini_and_hochberg():
    r = random.Random(7)
    for _ in range(50):
        ps = [10 ** -r.uniform(0, 8) if r.random() < 0.3 else r.random() for _ in range(200)]
        some = [p for p in ps if p <= secrets.FALSE_SHARE]
        (least,) = secrets.cuts([len(ps)], Counter((0, secrets.bin_of(p)) for p in some))
        # Each p-value counts as the greatest of its bin.
        edge = sorted(10 ** (-secrets.bin_of(p) / secrets.BINS) for p in some)
        ok = [e for k, e in enumerate(edge, 1) if e * len(ps) <= secrets.FALSE_SHARE * sum(x <= e for x in edge)]
        assert sum(secrets.bin_of(p) >= least for p in some) == sum(e <= max(ok, default=0) for e in edge)


def test_battery_reads_values_behind_names_and_mixed_marks():
    r = random.Random(6)
    for before, after, names in (
        ("DB_PASS=", "", ("base62", "base64", "base64url")), ("https://h.example/p?sig=", "&v=1", ("base62", "base64", "base64url")), ("AUTH=", "==", ("base62", "base64")),
        ("my-files/", "", ("base62", "base64url")), ("/var/log-files/", "/x", ("base62", "base64url")), ("some+words/", "_x", ("base62",)), ("a-", "", ("base64",)),
    ):
        for name in names:
            found = 0
            for _ in range(100):
                value = "".join(r.choice(secrets.ENCODINGS[name]) for _ in range(40))
                text = f"see {before}{value}{after} there"
                spans = [s for s in secrets.scan_text(text) if s[0] == "random"]
                at = text.index(value)
                found += any(s < at + 40 and at < e for _, s, e in spans)
                assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
            assert found >= 90, (before, name, found)
    for natural in ("PATH=/usr/local/share/some-package_files/README", "https://example.org/a-page/with_some/words-in-its/long+path/index2"):
        assert not [s for s in secrets.scan_text(f"x {natural} y") if s[0] == "random"], natural


def test_secret_report(spark):
    text = 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    got = {r["doc_id"]: r for r in secrets.report(docs(spark, [(1, text, "s"), (2, None, "s"), (1, "", "s"), (None, text, "s")], ", spans string")).collect()}
    assert got[None]["n_assign"] == 1 and got[None]["n_hex"] == 1
    assert got[None]["base_sha256"] == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest() and got[None]["spans"] == "assign:2:51,hex:11:51"
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.report(docs(spark, [])).count() == 0


# Web archive.


def test_archive_round_trip(spark):
    big = "<p>" + "ä" * 100
    rows = [(5, "http://a\r\n", big), (2, None, big), (9, "u", big), (1, "u", "tiny"), (3, "u", "tiny"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 100), (8, "u", "y" * 99), (10, "u", "y" * 99), (7, "u", "x" * 100), (None, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, b"p") for r in rows], "page_id bigint, url string, html string, payload binary").repartition(4)
    path = new_path(spark, "w")
    got = Counter(map(tuple, warc.archive_report(pages, path).collect()))
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = min((x[0] for x in rows if (x[2] or "").encode() == raw and x[0] is not None), default=None)
        answer = len(raw) < 100 or i == first
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if answer else "revisit", None if answer else first] += 1
    assert got == want
    for r in warc.read_archive(spark, path).collect():
        assert r["verified"] and r["record"] == r["header"].encode() + bytes(r["payload"]) + b"\r\n\r\n"
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == stored.select("digest").distinct().count() == len({(r[2] or "") for r in rows})
    assert warc.archive_report(pages.limit(0), new_path(spark, "w")).count() == 0


def test_archive_keeps_urls_and_gives_warc_files(spark):
    import io
    from pathlib import Path
    from urllib.parse import urlparse

    urls = ["http://a/", None, "", " http://b/\t", "http://c/\r\nWARC-Type: revisit", "http://d/%0D%0A?x=é", "\n", "a\u2028b"]
    html = ["<p>" + "ä🙂" * 60, "<p>" + "ä🙂" * 60, "", None, "WARC/1.1\r\n\r\nx\r\n\r\n", "\r\n\r\n", "x" * 300_000, "tiny"]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id bigint, url string, html string").repartition(3)
    path = new_path(spark, "w")
    warc.write_archive(pages, path, date="2024-05-06T07:08:09Z")
    records = warc.read_archive(spark, path)
    got = {r["page_id"]: r for r in warc.parse_headers(records).collect()}
    assert [got[i]["url"] for i in range(len(urls))] == urls
    warc.export_warc(records, f"{path}/warc")
    found = {}
    for file in Path(urlparse(path).path).glob("warc/part-*"):
        data = file.read_bytes()
        whole = [bytes(r["record"]) for r in got.values()]
        assert sum(x in data for x in whole) == len(list(warc.parse_warc(io.BytesIO(data))))
        for fields, block in warc.parse_warc(io.BytesIO(data)):
            names = [n for n, _ in fields]
            assert len(names) == len(set(names)) and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(names)
            f = dict(fields)
            assert f["WARC-Date"] == "2024-05-06T07:08:09Z"
            found[int(f["WARC-Record-ID"][len("<urn:page:") : -1])] = (f["WARC-Type"], block.decode())
    assert found == {i: ("response", h or "") if i != 1 else ("revisit", "") for i, h in enumerate(html)}
    with pytest.raises(ValueError):
        list(warc.parse_warc(io.BytesIO(whole[0][:-1])))


def test_damaged_archives_are_errors(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "u", "b" * 200)], "page_id bigint, url string, html string")
    path = new_path(spark, "w")
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads").collect()
    bad = spark.createDataFrame([(stored[0]["digest"], bytearray(b"c" * 200)), (stored[1]["digest"], stored[1]["payload"])], "digest string, payload binary")
    for payloads in (bad, bad.limit(0)):
        payloads.write.mode("overwrite").parquet(f"{path}/payloads")
        with pytest.raises(Exception, match="missing or damaged"):
            warc.report(spark, path).collect()


# Classifiers.


def labelled(n, bad):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        y, text = i % 4 == 0, [r.choice(words) for _ in range(r.randrange(5, 120))]
        rows.append((i, bad(text, r) if y else " ".join(text)))
        labels.append((i, int(not y), int(y)))
    return rows, labels


def insult(text, r):
    for _ in range(3):
        text.insert(r.randrange(len(text)), r.choice(["zzgrumble", "zzgrumbles", "zzgruff"]))
    return " ".join(text)


def test_toxicity_learns_and_covers_every_window(spark):
    rows, labels = labelled(400, insult)
    rows += [(900, None), (901, ""), (902, " "), (None, "zzgrumble it"), (903, "w " * 30000 + "zzgrumble " * 3 + "w " * 30000)]
    d = docs(spark, [(*x, 0.5) for x in rows], ", score double")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (3, 1, None)], LABELS)
    model = toxicity.fit(d, lab, steps=60)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [(i, t) for i, _, t in labels if toxicity.held_out(i)]
    assert sum((got[i] >= 0.5) == bool(t) for i, t in held) / len(held) > 0.9
    assert got[900] == got[901] == got[902] and got[900] < 0.5
    assert got[903] > 0.5  # its one bad place is in the middle of a very long text


def test_toxicity_learns_and_scores_alike():
    """Training moves the loss down, and scores do not depend on the batch."""
    rows, labels = labelled(80, insult)
    net = toxicity.train([t for _, t in rows], [y for _, _, y in labels], steps=60)
    s = toxicity.Scorer(net)([t for _, t in rows])
    y = np.array([t for _, _, t in labels])
    assert s[y == 1].mean() - s[y == 0].mean() > 0.5
    one_by_one = np.array([toxicity.Scorer(net)([t])[0] for _, t in rows[:20]])
    assert np.allclose(one_by_one, s[:20], atol=1e-5)


def double(net):
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_toxicity_gradients():
    """Every parameter's gradient against differences of the loss."""
    g = np.random.default_rng(3)
    net = double(toxicity.Network(["aa", "bb", "cc"], 5))
    words = ["aa", "bb", "unseen", "cc", "é中", "longer-word!"]
    wi, co = net.embed(words)[:2]
    local = np.concatenate([toxicity.windows(g.integers(1, 7, n), toxicity.WINDOW) for n in (3, 70, 0, 40)])
    starts = np.array([0, 1, 4, 5])
    y, weight = np.array([1.0, 0.0, 0.0, 1.0]), np.array([0.4, 1.0, 0.7, 2.0])

    def loss():
        z = toxicity.document_logits(net.logits(net.gates(net.inputs(wi, co)), local), starts)
        return float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum())

    _, grad = toxicity.gradients(net, wi, co, local, starts, y, weight)
    for name, p in net.p.items():
        used = np.flatnonzero(grad[name].ravel()) if name in ("char", "word") else np.arange(p.size)
        assert len(used)
        for i in g.choice(used, min(12, len(used)), replace=False):
            keep, d = p.flat[i], 1e-6
            p.flat[i] = keep + d
            up = loss()
            p.flat[i] = keep - d
            down = loss()
            p.flat[i] = keep
            assert grad[name].flat[i] == pytest.approx((up - down) / (2 * d), rel=1e-4, abs=1e-8), (name, i)


def test_toxicity_forward_pass_against_plain_loops():
    """Scores of texts, written out word by word and gate by gate."""
    net = double(toxicity.Network(["the", "bad", "word"], 9))
    g = np.random.default_rng(1)
    texts = [None, "", "The bad word, again", " ".join(g.choice(["the", "bad", "word", "ünseen", "x-y_z"], 75)), "中文" * 20]
    p, h = net.p, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def step_input(word):
        bare = word.strip(toxicity.MARKS) or word
        first = ord(bare[0])
        chars = p["char_b"] + p["char"][first if first < 128 else 128 + first % (toxicity.LETTERS - 128)]
        held = [1, *map(ord, bare), 2]
        for three in zip(held, held[1:], held[2:]):
            x = sum(o * f for o, f in zip(three, toxicity.FACTORS, strict=True)) % 2**64
            x = ((x ^ x >> 17) * toxicity.FACTORS[0] % 2**64) >> 15
            chars = chars + p["char"][toxicity.LETTERS + 1 + x % (toxicity.TRIGRAMS - 1)]
        return np.concatenate((p["word"][net.vocabulary.get(word, 0)], np.tanh(chars)))

    def states(xs, s):
        state, out = np.zeros(h), []
        for x in xs:
            pre, rec = x @ p[f"w{s}"] + p[f"c{s}"], p[f"u{s}"]
            z, r = sig(pre[:h] + state @ rec[:, :h]), sig(pre[h : 2 * h] + state @ rec[:, h : 2 * h])
            state = state + z * (np.tanh(pre[2 * h :] + (r * state) @ rec[:, 2 * h :]) - state)
            out.append(state)
        return out

    for text, got in zip(texts, toxicity.Scorer(net)(texts), strict=True):
        words, zs = toxicity.split_words(text), []
        for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            xs = [step_input(w) for w in words[at : at + toxicity.WINDOW]]
            both = [np.concatenate(ab) for ab in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
            e = np.exp([b @ p["att"] for b in both])
            zs.append((sum(w * b for w, b in zip(e / e.sum(), both, strict=True)) if both else np.zeros(2 * h)) @ p["out"] + p["bias"][0])
        soft = np.exp(np.array(zs) - max(zs))
        assert got == pytest.approx(sig((soft * zs).sum() / soft.sum()), abs=1e-9)


def test_labelled_samples_do_not_depend_on_the_order_of_rows(spark):
    """Ids with two texts or two labels: one choice, whatever the partitions."""
    rows = [(i, f"text {i} {k}") for i in range(60) for k in range(3)] + [(70, None), (71, "only")]
    lab = [(i, i % 2, i % 2) for i in range(60)] + [(5, 0, 0), (5, 1, 1), (7, 1, 1), (70, 1, 1), (71, 1, 1), (72, 1, 1), (None, 1, 1)]
    seen = set()
    for n in (1, 3, 7):
        d, labels = docs(spark, rows).repartition(n), spark.createDataFrame(lab, LABELS).repartition(n)
        got = toxicity.common.labelled_sample(d, labels, "toxic", 5, 0, {1: 20, 0: 20}, 1).collect()
        assert len({r["doc_id"] for r in got}) == len(got) == 40 and not {5, 70, 72} & {r["doc_id"] for r in got}
        assert sum(r["y"] for r in got) == 20 and all(not toxicity.held_out(r["doc_id"]) for r in got)
        seen.add(tuple(sorted(map(tuple, got))))
    assert len(seen) == 1


def test_toxicity_reads_all_of_long_words():
    for word in ("abcdefghijklmno", "".join(map(chr, range(97, 123))), "one_two/three-four.five", "".join(chr(0x4E00 + i) for i in range(500)), '"' + "abcdefghij" * 5 + '".', "https://h.example/a?b=c&d=e"):
        steps = toxicity.split_words(f"see {word} there")
        assert steps[0] == "see" and steps[-1] == "there" and all(len(s) <= 14 for s in steps)
        bare = word.strip(toxicity.MARKS) or word
        at = end = 0
        for s in steps[1:-1]:  # no character is left out, and every eight inside a part are in one step
            at = bare.index(s, at)
            assert at <= end
            end = max(end, at + len(s))
        assert end == len(bare)
        for part in re.split(r"[^\w]|_", bare):
            assert all(any(part[i : i + 8] in s for s in steps) for i in range(len(part) - 7))
    assert toxicity.split_words("Short words, (international) stay!!!!!!!!!!!") == ["short", "words,", "(international)", "stay!!!!!!!!!!!"]
    rows, labels = labelled(400, insult)
    score = toxicity.Scorer(toxicity.train([t for _, t in rows], [y for _, _, y in labels], steps=60))
    # Words that differ in the middle alone.
    assert len({round(float(x), 9) for x in score([f"abcdefghijkl{c}mnopqrstuvwx" for c in "xyzé中"])}) == 5
    clean, bad = "_".join(rows[1][1].split()[:30]), "_".join([*rows[1][1].split()[:15], "zzgrumble", "zzgruff", "zzgrumbles", *rows[1][1].split()[15:30]])
    assert score([clean])[0] < 0.5 < score([bad])[0]


def test_toxicity_reads_text_without_blanks():
    """Learnt from text with blanks, found in text without, wherever it stands."""
    rows, labels = labelled(600, insult)
    score = toxicity.Scorer(toxicity.train([t for _, t in rows], [y for _, _, y in labels], steps=150))
    y = np.array([y for _, _, y in labels])
    s = score(["".join(t.split()) for _, t in rows])
    assert (s[y == 1] >= 0.5).mean() >= 0.9 and (s[y == 0] >= 0.5).mean() <= 0.1


def test_toxicity_on_the_supplied_labels(spark):
    """Held-out rows of the larger table: all with a word that marks toxic texts there, with blanks and without."""
    base = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = d.join(lab.filter("toxic in (0, 1)"), "doc_id").filter(toxicity.common.doc_fold(F.col("doc_id"), 5) == 0).select("text", "toxic").collect()
    score = toxicity.Scorer(toxicity.fit(d, lab))
    marks = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
    with_words = np.array([any(m in r["text"].lower() for m in marks) for r in held])
    y = np.array([r["toxic"] for r in held])
    s = score([r["text"] for r in held])
    assert (s[with_words] >= 0.5).mean() >= 0.95 and (s[(y == 0) & ~with_words] >= 0.5).mean() <= 0.03
    s = score(["".join(r["text"].split()) for r in held])
    assert (s[with_words] >= 0.5).mean() >= 0.95 and (s[(y == 0) & ~with_words] >= 0.5).mean() <= 0.06


def test_toxicity_tells_letters_outside_ascii_apart():
    for block in ((0xC0, 0x180), (0x370, 0x4F0), (0x5D0, 0x5EB), (0xE01, 0xE3B), (0x3041, 0x30FF), (0x4E00, 0x4F00), (0xAC00, 0xAD00)):
        letters = [chr(i) for i in range(*block)]
        codes = toxicity.char_codes([*letters, *map(chr, range(32, 127))])
        assert len({tuple(c) for c in codes}) == len(codes)
    net = toxicity.Network([])
    assert (toxicity.char_codes(["ä" * 14, "\U0001f600" * 14]) < len(net.p["char"])).all()
    a, b = net.embed(["привет", "приват"])[2]
    assert not np.allclose(a, b)


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.contract(d, none).collect()] == [0.0, 0.0]
    assert toxicity.keep_clean(d, none).count() == 2
    assert toxicity.contract(docs(spark, []), none).count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, 15, 16, 17, 31, 32, 33, 100, 1000):
        w = toxicity.windows(np.arange(1, n + 1))
        assert set(w[w > 0]) == set(range(1, n + 1))


def test_quality_neighbours_equal_brute_force(spark):
    rows, labels = labelled(300, lambda text, r: " ".join(w.upper() + "!!" for w in text))
    rows += [(900, None), (901, ""), (None, "abc def"), (902, "x" * 200000)]
    d = docs(spark, [(*x, 1) for x in rows], ", label_id int")
    lab = spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in quality_knn.contract(d, lab).collect()}
    assert len(got) == len(rows)
    held = [(i, q) for i, q, _ in labels if got[i]["held_out"]]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in held)
    assert sum((got[i]["predicted"] == 1) == bool(q) for i, q in held) / len(held) > 0.97
    model = quality_knn.fit(d, lab)
    assert any(len(t or "") > 100_000 for _, t in rows)
    v = model.project(model.terms([(t or "").encode() for _, t in rows]))
    for (i, _), x in list(zip(rows, v, strict=True))[::7]:
        near = sorted(range(len(model.labels)), key=lambda j: -float(x @ model.vectors[j]))[: quality_knn.NEIGHBOURS]
        w = np.array([max(0.0, float(x @ model.vectors[j])) for j in near]) ** quality_knn.SHARPNESS
        want = float((w * model.labels[near]).sum() / w.sum()) if w.sum() > 1e-9 else model.share
        assert abs(got[i]["score"] - want) < 1e-3
    assert quality_knn.contract(docs(spark, []), lab).count() == 0
    assert [r["score"] for r in quality_knn.contract(docs(spark, [(1, "a")]), spark.createDataFrame([], LABELS)).collect()] == [0.0]
