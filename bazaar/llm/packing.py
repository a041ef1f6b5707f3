"""Best-fit-decreasing packing of token sequences.

Documents are tokenised in tasks; one longer than the capacity is cut into
pieces of the capacity, the last may be shorter.  Best-fit decreasing takes the
pieces by falling length and puts each into the open bin with the least room
that still suffices, found as the leftmost non-empty leaf of a segment tree
over remaining capacities.

A length is an integer of 1 to ``capacity``, and pieces of one length are
interchangeable, so the algorithm runs on the histogram of lengths: at most
``capacity`` counts reach the driver, whatever the size of the corpus.  Bins of
equal room are handled together, and a step places as many pieces at once as
best fit would place one after the other.  The result is a list of steps
(pieces from rank r on of length s go to bins from b on, q pieces to a bin);
its length depends on the capacity, not on the number of pieces.  Each piece
finds its rank among those of its length from counts per stored partition, and
its bin from the step that holds the rank.

Defined results: a null or empty text is one piece, the end id alone.  Rows
equal in all columns are packed each; ties among equal lengths go by stored
order.  ``pack_documents`` passes over extra columns; ``pack`` keeps its input's
columns and replaces those named like an output.  No rows give no rows.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.llm.common import cut, released, table

CAPACITY = 2048
#: Pretokens whose ids a worker remembers at a time.
REMEMBERED = 400_000
# The splitting pattern of the tokenizer file's pre-tokenizer.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters, common punctuation and plain white space: normalised, lowered and split alike
#: here and in the tokenizer (NFC leaves each of them as it is).
PLAIN = r"\t\n\r\x20-\x7e\xa1-įı-ɏ‐-‧€"


# -- tokens -------------------------------------------------------------------------

class Remembered(dict):
    """Word -> ids; those of a new word are computed when they are first asked for."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.compute(word)
        return got


def plain_split() -> Callable[[str], list[str]]:
    """``PRETOKEN``'s matches in a lowered text of plain characters: its classes spelt out, which ``re`` searches faster."""
    plain = re.compile(f"[{PLAIN}]").match
    low = sorted({x for c in map(chr, range(0x2100)) if plain(c) for x in c.lower()})
    pattern = PRETOKEN
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(name, "".join(c for c in low if regex.match(name, c)))
    return re.compile(pattern).findall


class Encoder:
    """Ids of texts under a word-BPE file, with the ids of repeated words remembered.

    Texts of common characters are normalised and split here, and each distinct
    pretoken goes through the file's BPE model once; every other text goes
    through the file's whole tokenizer.  Both give the same ids.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Remembered(self.word_ids)
        self.split = plain_split()
        special = "|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.special = regex.compile(special).search if special else lambda _: None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = lambda word: level.pre_tokenize_str(word)[0][0] if not word.isascii() else word

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def word_ids(self, word: str) -> bytes:
        """Ids of a pretoken, by the file's BPE model."""
        ids = [t.id for t in self.model.tokenize(self.as_bytes(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.odd(text) or self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.split(text.lower())))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of each document's ids and the end id, cut at the capacity.

    Without ``with_ids`` the ids themselves stay in the tasks.
    """
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
    if not with_ids:
        del kinds["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                row, rest = [], []
                for j, text in enumerate(part.column("text").to_pylist()):
                    ids = encoder.ids(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cell = ids[at:at + 4 * capacity]
                        row.append(j)
                        rest.append((k, at // 4, len(cell) // 4, zlib.crc32(cell), cell)[:len(kinds)])
                cols = [pa.array(x, k) for x, k in zip(zip(*rest), kinds.values())]
                if row:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *cols], ["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# -- best-fit decreasing over the histogram -------------------------------------------

class RoomTree:
    """Segment tree over remaining capacities 0..n: which have open bins, and the least one that suffices."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, room: int, open_bins: bool) -> None:
        i = room + self.size
        self.any[i] = open_bins
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room >= need with an open bin, in logarithmic time."""
        i = need + self.size
        while not self.any[i]:
            while i & 1:  # a right child: everything to its right lies above its parent
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, first rank, pieces, first bin, pieces a bin, first offset) and the number of bins.

    The same bins as placing one piece after the other: a bin that received a
    piece and has room for another of the same length is then the tightest.
    """
    tree, bins, steps = RoomTree(capacity), 0, []
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, number) of open bins

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            ranges.setdefault(room, []).append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                put(room, bins, -(-(end - rank) // (capacity // length)))
                bins += ranges[room][-1][1]
            first, n = ranges[room].pop()
            if not ranges[room]:
                tree.mark(room, False)
            fit = room // length
            full = min(n, (end - rank) // fit)
            if full:
                steps.append((length, rank, full * fit, first, fit, capacity - room))
                put(room - fit * length, first, full)
                rank += full * fit
            if rank < end and full < n:  # the last pieces go into one more of these bins
                rest = end - rank
                steps.append((length, rank, rest, first + full, rest, capacity - room))
                put(room - rest * length, first + full, 1)
                rank, full = end, full + 1
            put(room, first + full, n - full)
    return steps, bins


# -- Spark -----------------------------------------------------------------------------

def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``length``, 1 to capacity) with ``sequence_id`` and ``offset``."""
    spark = items.sparkSession
    # Each row is stored with a number that names its writing task and place, so
    # ranks stay what they are when tasks are repeated or files are split anew.
    items = items.drop("sequence_id", "offset", "_part", "_at", "_n", "_before", "_rank")
    tagged = cut(items.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    per_part = tagged.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths lie between 1 and the capacity")
    steps, _ = best_fit_decreasing(counts, capacity)
    by_length = {k: list(g) for k, g in itertools.groupby(steps, key=lambda s: s[0])}

    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_at")) - 1
    ranked = (tagged.withColumn("_rank", number).join(offsets, ["length", "_part"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")).select(*items.columns, "_rank"))
    sent = spark.sparkContext.broadcast({k: (np.array([s[1] for s in v]), np.array(v)) for k, v in by_length.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            bin_, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                first, steps = plan[int(s)]
                step = steps[np.searchsorted(first, rank[at], side="right") - 1]
                inside = rank[at] - step[:, 1]
                bin_[at] = step[:, 3] + inside // step[:, 4]
                offset[at] = step[:, 5] + inside % step[:, 4] * s
            keep = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bin_), pa.array(offset)], [*keep, "sequence_id", "offset"])

    out = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(released(place), out)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer or tokenizer_path(), capacity, with_ids=False), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
