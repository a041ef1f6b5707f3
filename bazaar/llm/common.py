"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import io
import os
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.session import checkpoint_root

#: Words of a text: maximal runs of bytes other than ASCII white space.
SPACES = r"[ \t\n\r\f\x0B]+"
#: Words in a shingle, and the similarity from which two texts are near copies.
SHINGLE_WORDS = 5
NEAR = 0.8


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once per application.

    A zip of the package goes to the shared folder and to Spark's list of
    Python files, so tasks can import it wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    uri = shared_folder(spark, "code")
    fs, folder = shared_fs(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/{package.name}.zip") as file:
        file.write(held.getvalue())
    spark.sparkContext.addPyFile(f"{uri}/{package.name}.zip")
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str, python: bool = True) -> DataFrame:
    """A table of a folder; with ``python``, tasks can import this package."""
    if python:
        ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all machines share."""
    return f"{checkpoint_root(spark).rstrip('/')}/llm-{kind}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written as Parquet in the shared folder.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and what non-deterministic steps have dealt out stays as it is.
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; at the end of a task what it has freed goes back to the machine.

    Python workers stay for later tasks, and an executor holds more of them than it has
    cores (steps that follow one another in a stage have one each): freed memory that
    each keeps to itself would add up.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            Rolling.forget()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError, TypeError):   # not glibc: it stays with the worker
                pass

    return task


def row_key() -> list[Column]:
    """Two 64-bit hashes that stand for a document: of its id and of its text (nulls too)."""
    return [F.xxhash64("doc_id").alias("_hd"), F.xxhash64("text").alias("_ht")]


def crc32_of_id() -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


# -- vectorised 64-bit hashing -------------------------------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


class Rolling:
    """Fingerprints of all substrings of an array of bytes (or of 64-bit hashes), from prefix sums modulo 2**64.

    With S[i] the sum of code[byte j] * base**j over j < i (a hash is its own code), the fingerprint of
    bytes [i, i + n) is (S[i + n] - S[i]) * base**-i, scrambled with n.
    """

    BASE = 0x5851F42D4C957F2D
    #: Powers that stay between tasks.
    KEPT = 1 << 16
    _pow = _inv = np.empty(0, dtype=np.uint64)
    _code = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Rolling._pow) < n + 1:
            size = 1 << max(16, (n + 1).bit_length())
            Rolling._pow = _powers(self.BASE, size)
            Rolling._inv = _powers(pow(self.BASE, -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self._code[data] if data.dtype == np.uint8 else data) * self._pow[:n], out=self.sums[1:])

    @classmethod
    def forget(cls) -> None:
        """Drop the powers kept for long texts."""
        if len(cls._pow) > cls.KEPT:
            Rolling._pow, Rolling._inv = Rolling._pow[:cls.KEPT].copy(), Rolling._inv[:cls.KEPT].copy()

    def all(self, length: int) -> np.ndarray:
        """Fingerprints of every substring of ``length`` bytes, by start."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self._inv[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self._inv[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than ASCII white space)."""
    inside = np.ones(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Starts and fingerprints of the words; about ``most`` bytes are fingerprinted at a time."""
    start, end = word_bounds(data)
    out, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + most, side="right")))
        low = start[i]
        out[i:j] = Rolling(data[low:end[j - 1]]).at(start[i:j] - low, end[i:j] - low)
        i = j
    return start, out


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprints of a text's word shingles, in order, repeats kept.

    A text of fewer words than a shingle has one shingle of all its words; a
    null text or one without words has none.
    """
    _, word = word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))
    if not len(word):
        return np.empty(0, dtype=np.uint64)
    n = min(words, len(word))
    out = np.full(len(word) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(Rolling.BASE) + word[i:i + len(out)])
    return out


def by_bytes(cells: list[bytes], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of consecutive cells of about ``most`` bytes together (at least one cell each)."""
    out, start, size = [], 0, 0
    for i, cell in enumerate(cells):
        if i > start and size + len(cell) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(cell)
    return [*out, (start, len(cells))] if cells else []


def shingle_batch(cells: list[bytes], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints of several texts end to end, and where each text's begin.

    The same fingerprints as ``shingle_hashes``; a text of fewer words has none.
    """
    data = np.frombuffer(b"\n".join(cells), dtype=np.uint8)
    starts = np.cumsum([0, *(len(c) + 1 for c in cells[:-1])])
    start, word = word_hashes(data)
    size = len(start) - words + 1
    if size < 1:
        return np.empty(0, dtype=np.uint64), np.zeros(len(cells) + 1, dtype=np.int64)
    text = np.searchsorted(starts, start, side="right") - 1
    out = np.full(size, words, dtype=np.uint64)
    for i in range(words):
        out = mix64(out * np.uint64(Rolling.BASE) + word[i:i + size])
    inside = text[:size] == text[words - 1:]
    return out[inside], np.concatenate([[0], np.cumsum(np.bincount(text[:size][inside], minlength=len(cells)))])


def shared_fs(uri: str):
    """(file system, path) of a folder that all machines reach under the same address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))

