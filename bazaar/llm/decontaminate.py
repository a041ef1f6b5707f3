"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if at least ``threshold`` of the item's
word shingles are among the document's.  Items are short and documents long, so
the Jaccard similarity of the two is tiny and plain MinHash would miss most
pairs.  Therefore items are partitioned by size: for items of 2**c to
2**(c + 1) - 1 shingles a document is cut into windows of 2**(c + 2) shingles, half
overlapping, so that each place of an item lies whole in one window.  In a
partition the containment threshold becomes a Jaccard threshold (from the sizes'
bounds), and that gives the number of hash functions at which a pair above it
shares a minimum with probability ``1 - MISS``.  A shared minimum makes a
candidate; exact shingle containment in the whole document decides.

The benchmark's signatures are broadcast in blocks of at most ``BLOCK_BYTES`` of
item text, one pass over the documents for each block, so any number of items is
searched with bounded memory.  Documents are read in a map without shuffle: a
passage that many documents share costs each of them its own rows only.

Defined results: an item or text that is null or without words is found nowhere;
an item of fewer words than a shingle is one shingle of all its words, searched
among the document's shingles of that many words; repeated rows on either side
give a row for each pair of rows; extra columns are passed over; no rows give no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import NEAR, SHINGLE_WORDS, by_bytes, mix64, released, shingle_batch, shingle_hashes, table

MISS = 1e-6
BLOCK_BYTES = 8 << 20


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def hashes_needed(size: int, threshold: float, miss: float = MISS) -> int:
    """Hash functions for items of ``size`` to 2 * size - 1 shingles in windows of 4 * size."""
    shared = threshold * size
    jaccard = shared / (4 * size + size - shared)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


@dataclass
class Partition:
    """Items of one size class and shingle length: exact sets and, per hash function, sorted minima."""

    words: int
    size: int
    rows: list[int]
    sets: list[np.ndarray]
    minima: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, words: int, size: int, items: list[tuple[int, np.ndarray]], threshold: float) -> Partition:
        a = _multipliers(hashes_needed(size, threshold))
        sign = np.array([(s[None, :] * a[:, None]).min(axis=1) for _, s in items]).T  # hash function x item
        order = np.argsort(sign, axis=1, kind="stable")
        return cls(words, size, [r for r, _ in items], [s for _, s in items], np.take_along_axis(sign, order, axis=1), order)

    @cached_property
    def seen(self) -> np.ndarray:
        """Per hash function, which slots of a small table some item's minimum falls in."""
        out = np.zeros((len(self.minima), 1 << self.bits), dtype=bool)
        np.put_along_axis(out, self.slot(self.minima).astype(np.int64), True, axis=1)
        return out

    @cached_property
    def bits(self) -> int:
        return min(18, max(12, (64 * len(self.rows)).bit_length()))

    def slot(self, minima: np.ndarray) -> np.ndarray:
        return (minima * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def match(self, function: int, least: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) pairs whose minima under a hash function agree."""
        minima, owner = self.minima[function], self.owner[function]
        for w in np.flatnonzero(self.seen[function][self.slot(least)]):
            low = np.searchsorted(minima, least[w])
            while low < len(minima) and minima[low] == least[w]:
                yield w, owner[low]
                low += 1


def build(items: list[str | None], threshold: float) -> list[Partition]:
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for row, text in enumerate(items):
        words = min(SHINGLE_WORDS, len((text or "").encode("utf-8", "surrogatepass").split()))
        if words:
            s = np.unique(shingle_hashes(text, words))
            groups.setdefault((words, 1 << (len(s).bit_length() - 1)), []).append((row, s))
    return [Partition.of(w, n, got, threshold) for (w, n), got in sorted(groups.items())]


def candidates(shingles: np.ndarray, starts: np.ndarray, parts: list[Partition]) -> set[tuple[int, int, int]]:
    """(text, partition, item) where some window of a text shares a minimum with an item.

    ``parts`` have the same shingle length and rising sizes.  A window is two
    neighbouring blocks of a text; the blocks of a larger size class consist of
    those of the smaller one, so each hash function reads the shingles once.
    """
    levels, size, first, number = [], 1, starts[:-1], np.diff(starts)
    for part in parts:
        factor, size = 2 * part.size // size, 2 * part.size
        number = -(-number // factor)
        inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        edges = np.repeat(first, number) + inside * factor
        first = np.cumsum(number) - number
        text = np.repeat(np.arange(len(number)), number)
        levels.append((edges, text, text[1:] == text[:-1]))
    found = set()
    for function, a in enumerate(_multipliers(max(len(p.minima) for p in parts))):
        least = shingles * a
        for k, (part, (edges, text, follows)) in enumerate(zip(parts, levels)):
            least = np.minimum.reduceat(least, edges)
            if function < len(part.minima):
                window = least.copy()
                np.minimum(window[:-1], least[1:], out=window[:-1], where=follows)
                found.update((int(text[w]), k, int(i)) for w, i in part.match(function, window))
    return found


def search(texts: list[str | None], parts: list[Partition], threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item row, its shingles, those found) of the items contained in some texts."""
    cells = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for _, group in groupby(parts, key=lambda p: p.words):
        group = list(group)
        for low, high in by_bytes(cells):
            shingles, starts = shingle_batch(cells[low:high], group[0].words)
            own: tuple[int, np.ndarray] | None = None
            if not len(shingles):
                continue
            for text, k, i in sorted(candidates(shingles, starts, group)):
                if own is None or own[0] != text:
                    own = text, np.unique(shingles[starts[text]:starts[text + 1]])
                item, there = group[k].sets[i], own[1]
                at = np.minimum(np.searchsorted(there, item), len(there) - 1)
                n = int((there[at] == item).sum())
                if n >= threshold * len(item):
                    yield low + text, group[k].rows[i], len(item), n


def _blocks(items: DataFrame, threshold: float, block_bytes: int) -> Iterator[tuple[list[Partition], list]]:
    """The benchmark's partitions and item ids, about ``block_bytes`` of item text at a time."""
    items = items.select("item_id", "text").distinct()  # rows equal in both are one item
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = items.where(deal == block).collect()  # one block, bounded
        yield build([r["text"] for r in rows], threshold), [r["item_id"] for r in rows]


def find_items(docs: DataFrame, items: DataFrame, threshold: float = NEAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and contained item: doc_id, item_id, n_shingles, n_found, containment."""
    doc_kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id")))

    def one(block) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, ids = sent.value
            for batch in batches:
                got = list(search(batch.column("text").to_pylist(), parts, threshold))
                if got:
                    row, item, n, found = (np.array(x) for x in zip(*got))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array([ids[i] for i in item]), pa.array(n), pa.array(found), pa.array(found / n)],
                                                     ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {doc_kind}, item_id {item_kind}, n_shingles long, n_found long, containment double")

    return reduce(DataFrame.unionByName, map(one, _blocks(items, threshold, block_bytes)))


def without_items(docs: DataFrame, items: DataFrame, threshold: float = NEAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, all columns as they are."""
    for block in _blocks(items, threshold, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block[0])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), dtype=bool)
                clean[[hit[0] for hit in search(batch.column("text").to_pylist(), sent.value, threshold)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(released(run), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` contained in texts of ``documents``."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Exact containment, without any hashing of shingles.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, k WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hits AS (SELECT ds.doc_id, bs.item_id, count(*) AS found FROM bs JOIN ds USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, found AS n_found, found / n AS containment FROM hits JOIN n USING (item_id) WHERE found >= 0.8 * n
"""
