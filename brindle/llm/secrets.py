"""Secret scans: fixed patterns, and a battery of randomness tests.

Patterns give the spans of kinds assign, access and hex.  Beyond them, runs
of ``MIN_RUN`` and more token characters are tested; ``=`` ends a run, for inside
one it divides a name from its value, and at the end it only pads.  A run that
holds marks of both base 64 alphabets is tested by its parts: what lies between
the marks of either alphabet, and between all of them; of parts that overlap,
the one least like text is listed.  The narrowest encoding that fits a run
(hex, base 32, letters or base 36 of one case, base 62, 64 or URL-safe 64) sets
an alphabet; digits alone are numbers and are not tested.

Three tests are made of each run: chi-squared over bands of the alphabet, the
number of runs above and below its middle, and the serial correlation of
neighbours.  Each is read twice.  Against uniform draws from the alphabet: a
run that any of them rejects is no secret.  And against text, whose letters
are uneven, whose characters keep to a class (digits, capitals, small letters,
marks) or, in words, change between vowels and consonants; what text gives has
a mean and a spread that follow the run's length.  The three deviations from
text, none counted for more than ``MOST``, so that no test decides alone, give
one p-value.

False finds are controlled over the whole corpus: for each class of lengths
the Benjamini-Hochberg procedure sets the greatest p-value that keeps the
expected share of natural runs among the finds below ``FALSE_SHARE``, given
how many runs of such lengths were tested in all documents.  ``scan_text``
takes its one text for the corpus.

The scan sees each whole text row by row; its spans are written, counted by
length and p-value (a table of fixed size) and read again, and never shuffled.

Defined results: null text is empty and has no spans; positions are code
points, end exclusive; null ids pass through; repeated rows are scanned each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Parts of a run that no alphabet fits as a whole.
PARTS = [re.compile(rf"[A-Za-z0-9{marks}]{{20,}}") for marks in ("+/", "_-", "+", "")]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RUN = 12, 18, 16, 20
FALSE_SHARE = 0.01
REJECT = 0.002
#: The most that one test's deviation from text counts, in standard deviations.
MOST = 4.0
#: Lengths from which a new class begins.
LENGTHS = (20, 32, 64, 128)
#: Candidates are counted in so many bins for each power of ten of their p-value.
BINS = 10

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from the narrowest to the widest.
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "letters": _LOWER, "LETTERS": _UPPER, "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER, "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
# Per cent of letters a to z in English text.
_LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.07)
#: Letters that are rare in English are less so elsewhere.
_RARE = 0.8
_NATURAL = {c: max(f, _RARE) / sum(max(x, _RARE) for x in _LETTERS) for c, f in zip(_LOWER, _LETTERS, strict=True)}
#: Bands of letters from common to rare, of about equal shares of text.
_BANDS = [sum(1 for x in _LETTERS if x > f) for f in _LETTERS]
_BAND = {c: min(4, sum(k > edge for edge in (1, 4, 8, 14))) for c, k in zip(_LOWER, _BANDS, strict=True)}
_BAND_SHARE = [sum(f for c, f in _NATURAL.items() if _BAND[c] == b) for b in range(5)]
_VOWELS = frozenset("aeiou")
#: In text, how often neighbours are of two classes, and how often vowels and
#: consonants change; how the places of neighbours in the alphabet go together
#: in text of several classes, and vowels with vowels in words.
CLASS_CHANGES, VOWEL_CHANGES, CLASS_SERIAL, VOWEL_SERIAL = 0.10, 0.60, 0.7, -0.3
#: Text changes in bursts: its variance is so many times that of independent changes.
BURSTS = 1.6
#: The runs and the serial correlation see much of the same.
SHARED = 0.7


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_z(chi: float, free: int) -> float:
    """A chi-squared value as a normal deviation (Wilson and Hilferty)."""
    return ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))


def _deviation(p: float) -> float:
    """The normal deviation whose upper tail is ``p``, up to ``MOST``."""
    return min(MOST, NormalDist().inv_cdf(1 - max(p, 1e-12)) if p < 1 else 0.0)


def _class(c: str) -> int:
    return 0 if c in _DIGITS else 1 if c in _UPPER else 2 if c in _LOWER else 3


def encoding_of(run: str) -> str | None:
    """The narrowest encoding of a run; None for digits alone and mixed marks."""
    seen = set(run)
    if seen <= set(_DIGITS):
        return None
    return next((name for name, alphabet in ENCODINGS.items() if seen <= set(alphabet)), None)


def _serial(at: np.ndarray) -> float:
    d = at - at.mean()
    return float((d[1:] * d[:-1]).sum() / max(1e-9, (d * d).sum()))


def randomness(run: str, alphabet: str) -> float:
    """The least p-value of the tests against uniform draws, times their number;
    chi-squared looks at bands of the alphabet and at classes of characters."""
    size, n = len(alphabet), len(run)
    at = np.array([alphabet.index(c) for c in run], float)
    bands = max(3, min(size, n // 5))
    seen = np.bincount((at * bands / size).astype(int), minlength=bands)
    share = np.bincount((np.arange(size) * bands / size).astype(int), minlength=bands) / size
    p_chi = _upper_tail(_chi_z(float(((seen - n * share) ** 2 / (n * share)).sum()), bands - 1))
    here = [sum(_class(c) == k for c in alphabet) / size for k in range(4)]
    classes = [k for k in range(4) if here[k]]
    p_class = 1.0
    if len(classes) > 1:
        drawn = Counter(map(_class, run))
        p_class = _upper_tail(_chi_z(sum((drawn[k] - n * here[k]) ** 2 / (n * here[k]) for k in classes), len(classes) - 1))
    high = at >= size / 2
    a = int(high.sum())
    b = n - a
    p_runs = 0.0
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = 2 * _upper_tail(abs(runs - mean) / spread)
    p_serial = 2 * _upper_tail(abs(_serial(at)) * math.sqrt(n)) if at.std() > 0 else 0.0
    return min(1.0, 4 * min(p_chi, p_class, p_runs, p_serial))


def natural_p(run: str, alphabet: str) -> float:
    """How likely text of this length deviates so far from text in the three tests.

    Chi-squared compares the letters with those of text, or, where the alphabet
    lacks letters or digits, asks how likely text does without them."""
    n, letters = len(run), [c.lower() for c in run if c.isalpha()]
    p_chi = 1.0
    if letters:
        seen = [0] * 5
        for c in letters:
            seen[_BAND[c]] += 1
        chi = sum((k - len(letters) * f) ** 2 / (len(letters) * f) for k, f in zip(seen, _BAND_SHARE, strict=True))
        p_chi = _upper_tail(_chi_z(chi, 4))
    held = set(alphabet.lower())
    p_lack = sum(f for c, f in _NATURAL.items() if c in held) ** len(letters) * (len(held & set(_DIGITS)) / 10) ** (sum(c in _DIGITS for c in run) if held & set(_DIGITS) else 0)
    z = [_deviation(min(1.0, 2 * min(p_chi, p_lack)))]
    classes = [_class(c) for c in run]
    if len(set(alphabet) - set(_UPPER)) and len(set(alphabet) - set(_LOWER)):
        changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
        z.append((changes - (n - 1) * CLASS_CHANGES) / math.sqrt((n - 1) * CLASS_CHANGES * (1 - CLASS_CHANGES) * BURSTS))
        z.append((CLASS_SERIAL - _serial(np.array([alphabet.index(c) for c in run], float))) * math.sqrt(n))
    else:
        vowel = np.array([c in _VOWELS for c in run.lower()], float)
        changes = int((vowel[1:] != vowel[:-1]).sum())
        z.append(((n - 1) * VOWEL_CHANGES - changes) / math.sqrt((n - 1) * VOWEL_CHANGES * (1 - VOWEL_CHANGES) * BURSTS))
        z.append((_serial(vowel) - VOWEL_SERIAL) * math.sqrt(n))
    return _upper_tail(sum(min(MOST, x) for x in z) / math.sqrt(3 + 2 * SHARED))


def parts_of(start: int, run: str) -> list[tuple[int, str]]:
    """A run (start, text), or its parts where it mixes both base 64 alphabets."""
    if not (any(c in run for c in "+/") and any(c in run for c in "-_")):
        return [(start, run)]
    return sorted({(start + m.start(), m[0]) for part in PARTS for m in part.finditer(run)})


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def candidates(runs: list[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """(start, end, p) of a document's runs (start, text) that may be secrets; of
    those that overlap, the one least like text."""
    tested = []
    for start, run in runs:
        name = encoding_of(run)
        if name and (p := natural_p(run, ENCODINGS[name])) <= FALSE_SHARE and randomness(run, ENCODINGS[name]) > REJECT:
            tested.append((p, start, start + len(run)))
    tested.sort(key=lambda x: (x[0], x[1] - x[2], x[1]))
    out: list[tuple[int, int, float]] = []
    for p, s, e in tested:
        if not any(a < e and s < b for a, b, _ in out):
            out.append((s, e, p))
    return out


def bin_of(p: float) -> int:
    """Bins of p-values, smaller p-values in higher bins."""
    return int(-math.log10(max(p, 1e-300)) * BINS)


def cuts(tested: list[int], found: dict[tuple[int, int], int]) -> list[int]:
    """For each class of lengths the least bin that is kept, by the
    Benjamini-Hochberg procedure over bins (each taken at its greatest p-value).

    ``tested`` counts runs by class, ``found`` candidates by (class, bin)."""
    out = []
    for c, m in enumerate(tested):
        least, n = 10**6, 0
        for b in sorted((b for k, b in found if k == c), reverse=True):
            n += found[c, b]
            if 10 ** (-b / BINS) * m <= FALSE_SHARE * n:
                least = b
        out.append(least)
    return out


def _looked_at(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, float]], list[int]]:
    """Spans of the patterns, candidates of the battery, and how many runs were tested by class."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    at, runs = 0, []
    # Runs of 16 and more characters lie inside words of 16 and more; no shorter word holds one.
    for word in text.split():
        if len(word) < MIN_HEX:
            continue
        at = text.index(word, at)
        out += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(word)]
        if len(word) >= MIN_RUN:
            runs += [part for m in RUN.finditer(word) for part in parts_of(at + m.start(), m[0])]
        at += len(word)
    runs = [(s, r) for s, r in runs if not any(a < s + len(r) and s < b for _, a, b in out)]
    # Every run was a chance to err, also those that the tests rejected.
    tested = [0] * len(LENGTHS)
    for _, r in runs:
        tested[length_class(len(r))] += 1
    return out, candidates(runs), tested


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text that is a corpus by itself: (kind, start, end), by start and then kind."""
    out, maybe, tested = _looked_at(text)
    least = cuts(tested, Counter((length_class(e - s), bin_of(p)) for s, e, p in maybe))
    out += [("random", s, e) for s, e, p in maybe if bin_of(p) >= least[length_class(e - s)]]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))
_SCANNED = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,class:int,bin:int>>, tested array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (run for whole in batches for run in common.slices(whole, (1,))):
        found, counts = [], []
        for t in batch.column(1).to_pylist():
            out, maybe, tested = _looked_at(t or "")
            spans = [(k, s, e, None, None) for k, s, e in out] + [("random", s, e, length_class(e - s), bin_of(p)) for s, e, p in maybe]
            spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
            found.append([dict(zip(("kind", "start", "end", "class", "bin"), x, strict=True)) for x in spans])
            counts.append(tested if any(tested) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "spans", "tested"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): an array of (kind, start, end) per row of ``docs``, under
    one control of false finds for all rows."""
    seen = common.materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan, _SCANNED), "secrets")
    classes = range(len(LENGTHS))
    total = seen.filter("tested is not null").agg(*(F.sum(F.col("tested")[c]).alias(f"t{c}") for c in classes)).first()
    maybe = seen.select(F.explode("spans").alias("s")).filter("s.kind = 'random'").groupBy("s.class", "s.bin").agg(F.count("*").alias("n"))
    # At most one row for each class and bin.
    found = {(r["class"], r["bin"]): r["n"] for r in maybe.collect()}
    least = F.array(*(F.lit(x) for x in cuts([total[c] or 0 for c in classes], found)))
    kept = F.filter("spans", lambda s: s["bin"].isNull() | (s["bin"] >= F.get(least, s["class"])))
    return seen.select("doc_id", F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
    )
