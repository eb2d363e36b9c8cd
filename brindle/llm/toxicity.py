"""Toxicity scores by a bidirectional gated recurrent network in numpy.

Input of a step is a word, or a piece of a word of more than ``LONG``
characters (cut at its inner marks, then into overlapping pieces): its own embedding (words seen in at least
``MIN_DOCS`` training documents; others share one) beside a character part
(embeddings of its first letter and of all its trigrams by hash, ends included, summed and
squashed), so that a string reads alike wherever it stands in a piece.
Two gated recurrent units read each window of words forwards and backwards;
attention pools their states into one vector and a logit.  Windows overlap by
half, every window of a text is scored, and the text's logit is the average
of its windows' logits weighted by their own soft maximum, so that one bad
window is enough in a long text.

Training (forward and backward passes, Adam) happens on the driver over a
bounded sample: at most ``max_train`` toxic and twice as many clean labelled
rows, chosen by a hash of their ids, of texts of up to ``max_chars`` characters
(both parameters of ``fit``); texts longer than that are never cut, other rows
stand in for them.  Every step reads a few of its texts with the blanks taken out,
which teaches the character part to read text without blanks.  Scoring is one
map over all rows; the model (about two megabytes) goes with the task.

Defined results: null, empty or blank text is scored from a window of padding
alone; null ids and repeated rows are scored as any other; an id that is
labelled both ways is not learnt from, and of rows that repeat a labelled id the
one whose text has the least hash is; without labelled
rows of both kinds every score is the share of label 1 (0 without labels);
an empty table gives an empty result; other columns are ignored by ``score``
and pass through ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 1500
MAX_TRAIN_CHARS = 20_000
MIN_DOCS = 3
MAX_WORDS = 20_000
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 16
LONG, ASCII, LETTERS, TRIGRAMS = 14, 128, 512, 1 << 15
#: Odd factors that mix three code points into a trigram's place in its table.
FACTORS = (2654435761, 2246822519, 3266489917)
#: Share of the training texts that are read without blanks in an epoch.
JOINED = 0.2
MARKS = ".,;:!?\"'()"
JOINS = re.compile(r"([!-/:-@\[-`{-~]+)")
BATCH, STEPS, ENOUGH = 48, 450, 0.003
SEED = 11
KNOWN_WORDS = 100_000


def pieces(word: str) -> list[str]:
    """A word as steps of at most ``LONG`` characters besides its outer marks.

    A longer one is cut at its inner marks, and what is still longer into
    pieces that overlap by half, so that all its characters are read.
    """
    if len(word) <= LONG:
        return [word]
    bare = word.strip(MARKS) or word
    if len(bare) <= LONG:
        return [word]
    out = []
    for part in JOINS.split(bare):
        last = len(part) - LONG
        out += [part[i : i + LONG] for i in (*range(0, last, LONG // 2), last)] if last > 0 else [part] if part else []
    return out


def split_words(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    return [p for w in words for p in pieces(w)] if any(len(w) > LONG for w in words) else words


def char_codes(words: list[str]) -> np.ndarray:
    """A row per word: the code of its first letter, and of each of its trigrams, with
    an end before and behind; 0 is nothing.  Outer marks are left out.

    Of letters, ASCII keep their code; others share those above it, and differ
    from all within 383 code points."""
    bare = [w.strip(MARKS) or w for w in words]
    text = "".join([f"\1{w}\2".ljust(LONG + 2, "\0") for w in bare])
    o = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), LONG + 2).astype(np.uint64)
    mixed = sum(o[:, k : k + LONG] * np.uint64(f) for k, f in enumerate(FACTORS))
    mixed = ((mixed ^ (mixed >> np.uint64(17))) * np.uint64(FACTORS[0]) >> np.uint64(15)) % np.uint64(TRIGRAMS - 1)
    grams = np.where(o[:, 2:] > 0, LETTERS + 1 + mixed.astype(np.int64), 0)
    first = o[:, 1:2].astype(np.int64)
    first = np.where(first < ASCII, first, ASCII + first % (LETTERS - ASCII))
    return np.concatenate((first, grams), 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _add_rows(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """``out[index] += rows`` where an index may repeat: sums of sorted runs."""
    if len(index):
        order = np.argsort(index, kind="stable")
        at = index[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] += np.add.reduceat(rows[order], first, axis=0)


class Network:
    """Parameters and the passes over windows (ids: windows x steps into a word table)."""

    def __init__(self, vocabulary: list[str], seed: int = SEED):
        g = np.random.default_rng(seed)
        f = lambda *shape, scale=0.3: (g.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": f(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": f(LETTERS + TRIGRAMS, CHAR_DIM),
            "char_b": f(CHAR_DIM, scale=0.01), "att": f(2 * h), "out": f(2 * h), "bias": np.zeros(1, np.float32),
        }
        for s in "fb":
            self.p |= {f"w{s}": f(d, 3 * h), f"u{s}": f(h, 3 * h), f"c{s}": np.zeros(3 * h, np.float32)}

    def embed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.vocabulary
        ids = np.array([known.get(w, 0) for w in words], np.int64)
        codes = char_codes(words)
        return ids, codes, self.inputs(ids, codes)

    def inputs(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Step inputs of words: word embedding beside squashed character sums."""
        chars = np.zeros((len(ids), CHAR_DIM), self.p["char"].dtype)
        table = self.p["char"].copy()
        table[0] = 0
        for j in range(codes.shape[1]):
            chars += table[codes[:, j]]
        return np.concatenate((self.p["word"][ids], np.tanh(chars + self.p["char_b"])), 1)

    def gates(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a word adds to all gates, either way; row 0 is padding."""
        x = np.concatenate((np.zeros((1, inputs.shape[1]), inputs.dtype), inputs))
        return tuple(x @ self.p[f"w{s}"] + self.p[f"c{s}"] for s in "fb")

    def states(self, gate: np.ndarray, ids: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States after each step, steps x windows x hidden; padding (0) holds the state."""
        h, n = HIDDEN, len(ids)
        u = self.p[f"u{side}"]
        out, state = np.empty((ids.shape[1], n, h), gate.dtype), np.zeros((n, h), gate.dtype)
        order = range(ids.shape[1]) if side == "f" else range(ids.shape[1] - 1, -1, -1)
        for t in order:
            at = ids[:, t]
            x = gate[at]
            zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + state @ u[:, : 2 * h])))
            z, r = zr[:, :h] * (at > 0)[:, None], zr[:, h:]
            cand = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((t, at, state, z, r, cand))
            state = state + z * (cand - state)
            out[t] = state
        return out

    def pool(self, both: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of windows by attention over their steps."""
        e = both @ self.p["att"]
        e = np.where(ids.T > 0, e, -30)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnd->nd", a, both)
        return pooled @ self.p["out"] + self.p["bias"][0], a, pooled

    def logits(self, gates: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
        both = np.concatenate((self.states(gates[0], ids, "f"), self.states(gates[1], ids, "b")), 2)
        return self.pool(both, ids)[0]


def windows(ids: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """All windows over a text's word ids, ``stride`` apart; 0 pads the last."""
    n = len(ids)
    starts = np.arange(0, max(1, n - WINDOW + stride), stride)
    padded = np.zeros(starts[-1] + WINDOW, ids.dtype)
    padded[:n] = ids[: len(padded)]
    return padded[starts[:, None] + np.arange(WINDOW)]


def document_logits(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One logit per document from its windows' logits: their average weighted by soft maximum."""
    counts = np.diff(np.append(starts, len(z)))
    top = np.repeat(np.maximum.reduceat(z, starts), counts)
    e = np.exp(z - top)
    return np.add.reduceat(e * z, starts) / np.add.reduceat(e, starts)


def gradients(net: Network, wi: np.ndarray, co: np.ndarray, local: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Summed loss of documents, and the gradient of their loss weighted by ``weight``.

    ``wi`` and ``co`` are word ids and character codes of the words in use,
    ``local`` the windows over them (0 is padding), ``starts`` each document's
    first window."""
    h = HIDDEN
    x = net.inputs(wi, co)
    gates = net.gates(x)
    kept: dict[str, list] = {"f": [], "b": []}
    both = np.concatenate([net.states(gates[k], local, s, kept[s]) for k, s in enumerate("fb")], 2)
    z, a, pooled = net.pool(both, local)
    counts = np.diff(np.append(starts, len(z)))
    doc_z = document_logits(z, starts)
    error = (_sigmoid(doc_z) - y) * weight
    loss = float(np.logaddexp(0, np.where(y > 0, -doc_z, doc_z)).sum())
    e = np.exp(z - np.repeat(np.maximum.reduceat(z, starts), counts))
    soft = e / np.repeat(np.add.reduceat(e, starts), counts)
    dz = np.repeat(error, counts) * soft * (1 + z - np.repeat(doc_z, counts))
    grad = {k: np.zeros_like(w) for k, w in net.p.items()}
    grad["bias"][0] = dz.sum()
    grad["out"] = pooled.T @ dz
    d_pooled = dz[:, None] * net.p["out"]
    d_both = a[:, :, None] * d_pooled[None]
    da = np.einsum("tnd,nd->tn", both, d_pooled)
    de = a * (da - (a * da).sum(0))
    grad["att"] = np.einsum("tn,tnd->d", de, both)
    d_both += de[:, :, None] * net.p["att"]
    d_x = np.zeros((len(wi) + 1, x.shape[1]), x.dtype)
    for k, s in enumerate("fb"):
        u, w = net.p[f"u{s}"], net.p[f"w{s}"]
        d_gate = np.zeros_like(gates[k])
        d_state = np.zeros((len(local), h), x.dtype)
        owners, parts = [], []
        for t, who, before, zt, rt, cand in reversed(kept[s]):
            d_state += d_both[t][:, k * h : (k + 1) * h]
            d_cand = d_state * zt * (1 - cand**2)
            d_z = d_state * (cand - before) * zt * (1 - zt)
            back = d_cand @ u[:, 2 * h :].T
            d_r = back * before * rt * (1 - rt)
            pre = np.concatenate((d_z, d_r, d_cand), 1) * (who > 0)[:, None]
            grad[f"u{s}"][:, : 2 * h] += before.T @ pre[:, : 2 * h]
            grad[f"u{s}"][:, 2 * h :] += (rt * before).T @ pre[:, 2 * h :]
            owners.append(who)
            parts.append(pre)
            d_state = d_state * (1 - zt) + (back * rt + np.concatenate((d_z, d_r), 1) @ u[:, : 2 * h].T) * (who > 0)[:, None]
        _add_rows(d_gate, np.concatenate(owners), np.concatenate(parts))
        d_gate[0] = 0
        grad[f"w{s}"] = np.concatenate((np.zeros((1, x.shape[1]), x.dtype), x)).T @ d_gate
        grad[f"c{s}"] = d_gate.sum(0)
        d_x += d_gate @ w.T
    d_x = d_x[1:]
    _add_rows(grad["word"], wi, d_x[:, :WORD_DIM])
    d_char = d_x[:, WORD_DIM:] * (1 - x[:, WORD_DIM:] ** 2)
    grad["char_b"] = d_char.sum(0)
    _add_rows(grad["char"], co.ravel(), np.repeat(d_char, co.shape[1], axis=0))
    grad["char"][0] = 0
    return loss, grad


def train(texts: list[str], labels: list[int], seed: int = SEED, steps: int = STEPS) -> Network:
    """About ``steps`` steps of Adam whatever the size of the sample, fewer once
    the mean loss of an epoch is below ``ENOUGH``."""
    # Texts are split one by one: of all words only the distinct ones are kept.
    index: dict[str, int] = {}
    seen: Counter = Counter()
    docs = []
    for text in texts:
        ws = split_words(text)
        seen.update(set(ws))
        # Every word counts once in training; overlapping windows are for scoring.
        docs.append(windows(np.array([index.setdefault(w, len(index) + 1) for w in ws], np.int32), WINDOW))
    vocabulary = sorted((w for w, n in seen.items() if n >= MIN_DOCS), key=lambda w: (-seen[w], w))[:MAX_WORDS]
    net = Network(vocabulary, seed)
    g = np.random.default_rng(seed)
    word_ids = np.array([net.vocabulary.get(w, 0) for w in index], np.int64)
    every = list(index)
    codes = np.empty((len(every), LONG + 1), np.int32)
    for at in range(0, len(every), 8192):  # what it is worked out from takes far more room
        codes[at : at + 8192] = char_codes(every[at : at + 8192])
    del every
    y = np.array(labels, np.float32)
    share = y.mean()
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step = 0
    batches = -(-len(docs) // BATCH)
    for epoch in range(-(-steps // batches)):
        order, loss = g.permutation(len(docs)), 0.0
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            # Now and then a text is read without its blanks; its pieces are not kept.
            extra: dict[str, int] = {}
            place = lambda w: index.get(w) or extra.setdefault(w, len(index) + len(extra) + 1)  # noqa: E731, B023
            read = [windows(np.array([place(w) for w in split_words("".join((texts[i] or "").split()))], np.int32), WINDOW) if g.random() < JOINED else docs[i] for i in pick]
            ids = np.concatenate(read)
            starts = np.cumsum([0, *map(len, read[:-1])])
            used, local = np.unique(ids, return_inverse=True)
            used = used[used > 0]
            local = local.reshape(ids.shape) + (0 if len(used) < len(np.unique(ids)) else 1)
            old, new = used[used <= len(index)], used[used > len(index)]
            wi, co = word_ids[old - 1], codes[old - 1]
            if len(new):  # ids run on, so these are all of them in order
                wi = np.concatenate((wi, [net.vocabulary.get(w, 0) for w in extra]))
                co = np.concatenate((co, char_codes(list(extra))))
            # Now and then a known word is hidden, so that its characters must do.
            wi = np.where(g.random(len(wi)) < 0.3, 0, wi)
            batch_loss, grad = gradients(net, wi, co, local, starts, y[pick], weight[pick] / len(pick))
            loss += batch_loss
            step += 1
            rate = 0.02 if step < 0.6 * steps else 0.01 if step < 0.8 * steps else 0.004
            for k, w in net.p.items():
                d = np.clip(grad[k], -1, 1, out=grad[k])
                m[k] *= np.float32(0.9)
                m[k] += np.float32(0.1) * d
                v[k] *= np.float32(0.99)
                v[k] += np.float32(0.01) * d * d
                w -= np.float32(rate / (1 - 0.9**step)) * m[k] / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-7))
        if epoch >= 4 and loss < ENOUGH * len(docs):
            break
    return net


class Scorer:
    """Scores texts; keeps what words add to the gates from one batch to the next."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.gates = net.gates(np.zeros((0, WORD_DIM + CHAR_DIM), np.float32))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        split = [split_words(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.__init__(self.net)
        known = self.known
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in known))
        if new:
            known.update(zip(new, range(len(known) + 1, len(known) + 1 + len(new)), strict=True))
            add = self.net.gates(self.net.embed(new)[2])
            self.gates = tuple(np.concatenate((old, more[1:])) for old, more in zip(self.gates, add, strict=True))
        docs = [windows(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))) for ws in split]
        starts = np.cumsum([0, *map(len, docs[:-1])])
        every = np.concatenate(docs)
        z = np.concatenate([self.net.logits(self.gates, every[i : i + 4096]) for i in range(0, len(every), 4096)])
        return _sigmoid(document_logits(z.astype(np.float64), starts))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS, steps: int = STEPS) -> Network | float:
    """A network from labelled rows outside fold 0, or a constant score: at most
    ``max_train`` toxic and twice as many clean ones, of texts of up to
    ``max_chars`` characters."""
    common.give_back(docs.sparkSession)
    sample = common.labelled_sample(docs.filter(F.length("text") <= max_chars), labels, "toxic", folds, 0, {1: max_train, 0: 2 * max_train}, SEED)
    sample = sorted(sample.collect(), key=lambda r: r["doc_id"])
    y = [r["y"] for r in sample]
    if len(set(y)) < 2:
        return float(y[0]) if y else 0.0
    net = train([r["text"] for r in sample], y, steps=steps)
    del sample
    common.give_back(docs.sparkSession)  # training takes far more room than the network
    return net


def _scoring(model: Network | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if isinstance(model, Network) else None
        for batch in batches:
            for rows in common.slices(batch, (1,)):
                scores = scorer(rows.column(1).to_pylist()) if scorer else np.full(len(rows), model)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scoring(model), "doc_id bigint, score double")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (common.doc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``; one map, no shuffle."""
    model, schema = fit(docs, labels), docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if isinstance(model, Network) else None
        for batch in batches:
            for rows in common.slices(batch, (at,)):
                scores = scorer(rows.column(at).to_pylist()) if scorer else np.full(len(rows), model)
                yield rows.filter(pa.array(scores < threshold))

    return docs.mapInArrow(common.trimmed(run), schema)
