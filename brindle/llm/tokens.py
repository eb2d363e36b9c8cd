"""Token ids in directly addressable binary files.

Format.  A segment holds the ids of consecutive documents.  Every id is cut
into chunks of ``CHUNK_BITS``; level 0 holds the lowest chunk of every id,
level 1 the next chunk of those ids that have one, and so on.  A bitmap per
level says which entries go on, and a rank directory (ones before each block
of ``BLOCK`` bits) leads from an entry to its place on the next level.  One
id is read by a few look-ups, without decoding what stands before it.

A segment's bytes, little-endian::

    magic "DACS" | u32 version | u64 ids | u64 documents | u32 levels
    u64 running ends of the documents (one each)
    per level: u64 entries | chunks (one byte each) |
               bitmap (entries + 7) // 8 | u32 directory, one per block and one more

Segments are values of the binary column ``segment`` of a Parquet folder,
beside ``part``, ``seq`` and the documents' ids, in ascending doc_id order,
so any store that Spark reaches will do and a lost executor loses no file.

Defined results: null text is empty and gets the end id alone; null doc_ids
come first; rows that repeat a doc_id are documents of their own, ordered by a
hash of their text and then the text; an empty table gives an empty folder; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CHUNK_BITS = 8
BLOCK = 512
MAGIC = b"DACS"
END_ID = 2
#: A segment is closed once it has this many ids; a document never straddles two.
SEGMENT_IDS = 1 << 20
#: So many documents are read at a time.
RUN = 64
#: Text is encoded in runs of about so many bytes.
SLICE_BYTES = 8 << 20


def encode_segment(ids: np.ndarray, ends: np.ndarray) -> bytes:
    out = [MAGIC, struct.pack("<I", 1), struct.pack("<QQ", len(ids), len(ends))]
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        padded = np.zeros(-(-max(len(rest), 1) // BLOCK) * BLOCK, np.uint8)
        padded[: len(rest)] = goes_on
        ranks = np.concatenate(([0], np.cumsum(padded.reshape(-1, BLOCK).sum(1)))).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = more[goes_on]
        if not len(rest):
            break
    out += [struct.pack("<I", len(levels)), ends.astype("<u8").tobytes(), *levels]
    return b"".join(out)


class Segment:
    """Reads a segment; ``segment[i]`` is one id, ``ids()`` all of them."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        self.n, docs = struct.unpack_from("<QQ", data, 8)
        (levels,) = struct.unpack_from("<I", data, 24)
        self.ends, at = np.frombuffer(data, "<u8", docs, 28), 28 + 8 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", -(-max(n, 1) // BLOCK) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bits[block * BLOCK // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += CHUNK_BITS
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            value = chunks.astype(np.uint32)
            if goes_on.any():
                value[goes_on] |= out << CHUNK_BITS
            out = value
        return out

    def _rank(self, level: int, i: int) -> int:
        """How many of the level's first ``i`` entries go on, by its directory."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        ones = int(ranks[block]) + int(np.bitwise_count(bits[block * BLOCK // 8 : i >> 3]).sum())
        return ones + (int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end``.  Entries of a run that go on are a run of the
        next level, whose ends the directory gives; nothing else is decoded."""
        runs = []
        for level in range(len(self.levels)):
            if start >= end:
                break
            runs.append((level, start, end))
            start, end = self._rank(level, start), self._rank(level, end)
        out = np.zeros(0, np.uint32)
        for level, a, b in reversed(runs):
            chunks, bits, _ = self.levels[level]
            value = chunks[a:b].astype(np.uint32)
            if len(out):
                goes_on = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
                value[goes_on] |= out << CHUNK_BITS
            out = value
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


#: Letters whose normal form is one lower-case letter each, then marks other than the apostrophe.
_PLAIN = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"


class BatchTokenizer:
    """Ids of whole texts, a batch at a time and without a step per word.

    The vocabulary's pre-tokenizer never joins across white space and its
    normalizer works word by word, so a text's ids are those of its words in
    turn.  A plain word (letters of the Latin blocks, perhaps with ASCII
    marks behind) is cut into its lower-cased letters and its marks, each one
    piece to the pre-tokenizer; the batch's distinct pieces are encoded many
    at a time and told apart by the ids that end a piece.  Any other distinct
    word is encoded alone.  Ids are then gathered piece by piece.
    """

    def __init__(self, path: str, end_id: int):
        # One thread per worker: a task has one core, and threads keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner, self.end_id = Tokenizer.from_file(path), end_id
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and how many each has."""
        flat, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 16):  # the library's results take far more room than their ids
            ids = [e.ids for e in self.inner.encode_batch_fast(texts[at : at + 16], add_special_tokens=False)]
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32))
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.concatenate(flat), np.concatenate(counts)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = self._encode([" ".join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)])
        cuts = np.flatnonzero(self.ends[flat]) + 1
        if len(cuts) != len(pieces):  # a piece that is not one to the pre-tokenizer
            return self._encode(pieces)
        return flat, np.diff(cuts, prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text), end ids included."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = lists.flatten()
        filled = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        last = before[offsets[1:]]  # words up to the end of each text
        coded = flat.filter(filled).dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        letters = pc.utf8_lower(cut.field(0).filter(cut.is_valid())).dictionary_encode()
        marks = cut.field(1).filter(cut.is_valid()).dictionary_encode()
        parts = [
            (np.array([self.end_id], np.uint32), np.array([1])), (np.zeros(0, np.uint32), np.array([0])),
            self._encode_pieces(letters.dictionary.to_pylist()), self._encode([x or "" for x in marks.dictionary.to_pylist()]),
            self._encode(words.filter(pa.array(~plain)).to_pylist()),
        ]
        pool, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        starts = np.cumsum(sizes) - sizes
        n_letters, n_marks = len(letters.dictionary), len(marks.dictionary)
        first, second = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        first[plain] = 2 + letters.indices.to_numpy(zero_copy_only=False)
        second[plain] = 2 + n_letters + marks.indices.to_numpy(zero_copy_only=False)
        first[~plain] = 2 + n_letters + n_marks + np.arange(len(words) - plain.sum())
        pieces = np.empty(2 * len(at), np.int64)
        pieces[::2], pieces[1::2] = first[at], second[at]
        pieces = np.insert(pieces, 2 * last, 0)
        lengths = sizes[pieces]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(starts[pieces] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(ends[2 * last + np.arange(len(last))], prepend=0)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE_BYTES`` of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + SLICE_BYTES)))
        yield batch.slice(at, end - at)
        at = end


def _writer(tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = BatchTokenizer(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for run in _slices(batch):
                ids, counts = encode(run.column(1))
                ends, at = np.cumsum(counts), 0
                while at < len(run):
                    done = int(ends[at - 1]) if at else 0
                    end = max(at + 1, int(np.searchsorted(ends, done + SEGMENT_IDS)))
                    blob = encode_segment(ids[done : int(ends[end - 1])], ends[at:end] - done)
                    docs = run.column(0).slice(at, end - at).to_pylist()
                    yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": int(ends[end - 1]) - done, "docs": docs, "segment": blob}], schema=_SEGMENT)
                    at, seq = end, seq + 1

    return write


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("segment", pa.binary())])
_SEGMENT_DDL = "part int, seq int, n_ids bigint, docs array<bigint>, segment binary"


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write ``docs`` (doc_id, text) as segments under ``path``, doc_id ascending.

    Texts are dealt by ranges of (doc_id, hash of text), so neither one long
    run of ids nor one repeated id lands in a single task as a whole corpus.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    written = dealt.select("doc_id", "text").mapInArrow(common.trimmed(_writer(tokenizer_path, end_id)), _SEGMENT_DDL)
    written.write.option("compression", "none").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, blob, at in zip(*batch.columns, strict=True):
            segment, rows, start = Segment(blob.as_buffer()), [], 0
            names, ends, before = docs.as_py(), segment.ends.tolist(), at.as_py()
            for k in range(0, len(names), RUN):  # a run of documents takes two look-ups a level
                first = start
                raw = memoryview(segment.span(first, ends[min(k + RUN, len(ends)) - 1]).astype("<u4", copy=False)).cast("B")
                for doc, end in zip(names[k : k + RUN], ends[k : k + RUN], strict=True):
                    rows.append((doc, before + start, end - start, zlib.crc32(raw[4 * (start - first) : 4 * (end - first)])))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, schema=_REPORT)


_REPORT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, n_ids, at): each segment, and how many ids stand before it.

    Segments are summed up by part; running sums go over the parts, of which
    there are as many as writing tasks, and then inside each part."""
    heads = spark.read.schema(_SEGMENT_DDL).parquet(path).groupBy("part", "seq").agg(F.max("n_ids").alias("n_ids"))
    heads = common.materialize(heads, "token-heads")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("all")).withColumn("part_at", before("all", Window.orderBy("part")))
    inside = heads.withColumn("inner_at", before("n_ids", Window.partitionBy("part").orderBy("seq")))
    placed = inside.join(parts.select("part", "part_at"), "part").select("part", "seq", "n_ids", (F.col("part_at") + F.col("inner_at")).alias("at"))
    # Written, so that the planner knows its size and need not shuffle the segments for a join.
    return common.materialize(placed, "token-starts")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all before it), n_tokens, ids_crc32, all from the files.

    Documents are read a few at a time, through the rank directories."""
    placed = spark.read.schema(_SEGMENT_DDL).parquet(path).join(segment_starts(spark, path).select("part", "seq", "at"), ["part", "seq"])
    return placed.select("docs", "segment", "at").mapInArrow(common.trimmed(_reader), T.StructType.fromDDL("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob, places, at in zip(*batch.columns, strict=True):
            segment, found = Segment(blob.as_buffer()), places.as_py()
            ids = [segment[p - at.as_py()] for p in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids, pa.int64())], names=["position", "token_id"])


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token_id) for each distinct ``position`` of a table that is in the corpus.

    A position's segment is met by equality: both fall into cells of
    ``SEGMENT_IDS`` ids, and a segment is a row for each cell that it touches.
    Only the segments asked for are opened, and each id takes a few look-ups."""
    starts = segment_starts(spark, path).filter("n_ids > 0")
    cell = lambda c: F.floor(c / SEGMENT_IDS)
    touched = starts.withColumn("cell", F.explode(F.sequence(cell(F.col("at")), cell(F.col("at") + F.col("n_ids") - 1))))
    asked = positions.select(F.col("position").cast("long")).filter("position >= 0").distinct().withColumn("cell", cell(F.col("position")))
    hit = asked.join(touched, "cell").filter("position >= at and position < at + n_ids")
    # A segment's positions are at most its ids.
    hit = common.materialize(hit.groupBy("part", "seq", "at").agg(F.collect_list("position").alias("places")), "token-asked")
    return segments(spark, path).join(hit, ["part", "seq"]).select("segment", "places", "at").mapInArrow(_finder, T.StructType.fromDDL("position bigint, token_id bigint"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments, for :class:`Segment`."""
    return spark.read.schema(_SEGMENT_DDL).parquet(path)


def encode_documents(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    write_files(docs, path, tokenizer_path, end_id)
    return read_files(docs.sparkSession, path)
