"""Quality scores by nearest-neighbour voting on latent-semantic vectors.

Terms of a text are its common words (known from the labelled sample) and the
trigrams of its bytes' kinds (lower case, capitals, digits, blanks, line ends,
marks, symbols, other letters), which say how it is written whatever its
language, plus how much of it repeats.  Weighted counts are brought down to
``DIMENSIONS`` by a truncated singular value decomposition of the labelled
sample.  The sample is at most ``max_train`` rows (a parameter of ``fit``) whatever the
corpus, chosen by a hash of their ids, of texts of any length: words are
counted and texts turned into term vectors in tasks, and only those vectors
of fixed size come to the driver.  The sample's latent vectors
go to every task; each document's cosines with all of them are one blocked
matrix product, exact and complete, and the ``NEIGHBOURS`` nearest vote with
their similarity.

Scoring is one map over whole texts without a shuffle.

Defined results: null, empty or blank text has the zero vector and gets the
sample's share of label 1, as does any text without a similar neighbour; null
ids and repeated rows are scored as any other; an id that is labelled both
ways is not learnt from, and of rows that repeat a labelled id the one whose
text has the least hash is; without labelled rows the
score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 3000
MAX_WORDS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 512
SHARPNESS = 8
KINDS = 8
SEED = 23


def _kinds() -> np.ndarray:
    kind = np.full(256, 7, np.int64)  # parts of letters beyond ASCII
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\r\x0b\x0c", 3), ("\n", 4), (".,;:!?'\"()-", 5)):
        kind[[ord(c) for c in chars]] = k
    for b in range(33, 127):
        if kind[b] == 7:
            kind[b] = 6
    return kind


_KIND = _kinds()


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of trigrams of byte kinds, a row per text; nothing joins two texts."""
    lengths = np.array([len(t) for t in texts])
    k = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    code = np.full(len(k), -1, np.int64)
    if len(k) > 2:
        code[:-2] = (k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:]
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    for back in (1, 2):  # the last two of a text begin no trigram
        at = ends[lengths >= back] - back
        code[at] = -1
    ok = code >= 0
    size = KINDS**3
    return np.bincount(owner[ok] * size + code[ok], minlength=len(texts) * size).reshape(len(texts), size)


def repeated_share(words: list[bytes], lines: list[bytes]) -> tuple[float, float, float]:
    """Shares of repeated triples of words and of repeated lines, and of neighbours that are equal."""
    pairs = len(words) - 1
    if pairs < 1:
        return 0.0, 0.0, 0.0
    again = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, pairs - 1) if pairs > 1 else 0.0
    twice = sum(map(bytes.__eq__, words, words[1:])) / pairs
    return max(0.0, again), 1 - len(set(lines)) / max(1, len(lines)), twice


def raw_terms(texts: list[bytes], words: dict[bytes, int]) -> np.ndarray:
    """Unweighted terms, a row per text."""
    size = KINDS**3
    out = np.zeros((len(texts), size + len(words) + 3), np.float32)
    counts = trigram_counts(texts)
    out[:, :size] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    for i, t in enumerate(texts):
        ws = t.lower().split()
        at = [a for a in map(words.get, ws) if a is not None]
        if at:
            out[i, size:-3] = np.sqrt(np.bincount(at, minlength=len(words)) / len(ws))
        out[i, -3:] = np.sqrt(repeated_share(ws, [x for x in t.split(b"\n") if x.strip()])) if len(ws) > 1 else 0
    return out


class Model:
    """Vocabulary, weights, projection and labelled vectors, from the sample's unweighted terms."""

    def __init__(self, words: list[bytes], raw: np.ndarray, labels: list[int]):
        self.words = {w: i for i, w in enumerate(words)}
        self.weight = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 0.1).astype(np.float32)
        self.weight[KINDS**3 : -3] *= 0.5
        self.weight[-3:] = 1.0
        x = raw * self.weight
        g = np.random.default_rng(SEED)
        # Randomised range finder, then the small decomposition.
        k = min(DIMENSIONS, *x.shape)
        q = np.linalg.qr(x.T @ g.standard_normal((len(x), k + 10)).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = (q @ vt[:k].T).astype(np.float32)
        self.labels = np.array(labels, np.float32)
        self.share = float(self.labels.mean())
        self.vectors = self.project(x)

    def terms(self, texts: list[bytes]) -> np.ndarray:
        return raw_terms(texts, self.words) * self.weight

    def project(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.basis
        return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            v = self.project(self.terms(texts[at : at + BLOCK]))
            cosines = v @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(0, np.take_along_axis(cosines, near, 1)).astype(np.float64) ** SHARPNESS
            total = w.sum(1)
            out[at : at + BLOCK] = np.where(total > 1e-9, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-9), self.share)
        return np.clip(out, 0, 1)


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches, and their texts in UTF-8."""
    for batch in batches:
        for rows in common.slices(batch, (column,)):
            yield rows, [(x or "").encode() for x in rows.column(column).to_pylist()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _runs(batches, 2):
        seen = Counter(w for t in texts for w in set(t.lower().split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def _vectors(words: list[bytes]):
    known = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _runs(batches, 2):
            x = raw_terms(texts, known)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_train: int = MAX_TRAIN) -> Model | None:
    """A model from at most ``max_train`` labelled rows outside fold ``held``; None without any."""
    sample = common.labelled_sample(docs, labels, "quality", folds, held, {None: max_train}, SEED)
    sample = common.materialize(sample.select("doc_id", "y", "text"), "quality-sample")
    counted = sample.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()]
    # Rows of fixed size, at most max_train.
    rows = sorted(sample.mapInArrow(_vectors(words), "doc_id bigint, y int, x binary").collect(), key=lambda r: r["doc_id"])
    return Model(words, np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["y"] for r in rows]) if rows else None


def _scoring(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _runs(batches, 1):
            scores = model.score(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scoring(model), "doc_id bigint, score double")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (common.doc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
