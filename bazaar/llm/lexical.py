"""Ranked lexical search with pair-bound MaxScore.

Each item's terms are scored against all documents with integer BM25-like impacts, and
the ten best documents are found without scoring the others:

1. *Index.*  Documents are tokenised once, in blocks, into inverted lists of the
   items' terms (document, occurrences), stored with the documents' lengths.
   Corpus counts (documents, terms, document frequencies) come from the index.
2. *Impacts and pairs.*  In a block a posting's impact is its share of a score.
   Terms of an item with similar frequency form pairs; a pair's intersection list is
   made once per block, for all items that have the pair, with the joint maximum: the
   highest sum of both impacts in one document.
3. *Bounds.*  A document without the whole pair gets at most the pair's larger term
   maximum from it, one with the pair at most the joint maximum; either is at most the
   sum of the two term maxima, which plain MaxScore has to assume.
   * If all larger maxima together are below the tenth score so far, only documents
     on intersection lists can matter, and of these only such whose lists raise the bound
     far enough.
   * Otherwise the pairs of least bound that stay below the tenth score together
     are not essential: documents that only they hold are skipped.
   What remains is scored pair by pair, highest bound first, and left as soon as
   the bounds of the pairs to come cannot lift it.
4. A task keeps ten documents an item over all its blocks; the tasks' tens are
   merged by a window, of which Spark takes the first ten before the shuffle.

Items go in blocks of about ``BLOCK_BYTES`` of text: a stated query set against all rows.

Defined results: a null or termless text is no document for the counts and is never
found; equal scores go by ascending doc_id (null last); rows equal in all columns are
documents of their own; items equal in id and text are one item; an item without terms,
or whose terms no document has, has no rows; terms are told apart by 64-bit
fingerprints; very long texts are tokenised in pieces; extra columns are passed over;
no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from bazaar.llm.common import Rolling, by_bytes, cut, table

TOP = 10
#: Text of an item block, of a document block, and documents in one.
BLOCK_BYTES, TEXT_BYTES, DOCS = 4 << 20, 2 << 20, 4096
#: Bytes that are fingerprinted at a time.
PIECE = 1 << 20

#: Bytes of terms: digits, letters and all of non-ASCII characters; capital letters are lowered.
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


# -- terms ----------------------------------------------------------------------------

def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that cut no term."""
    low = 0
    while low < len(data):
        high = low + PIECE
        while high < len(data):
            outside = np.flatnonzero(~_INSIDE[data[high:high + PIECE]])
            if len(outside):
                high += int(outside[0])
                break
            high += PIECE
        yield low, min(high, len(data))
        low = high


def term_hashes(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and fingerprints of the terms of some bytes, a piece at a time."""
    for low, high in _pieces(data):
        part = data[low:high]
        inside = np.zeros(len(part) + 2, dtype=bool)
        inside[1:-1] = _INSIDE[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        yield start + low, Rolling(_LOWER[part]).at(start, end)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def item_terms(text: str | None) -> np.ndarray:
    """The fingerprints of an item's different terms."""
    found = [h for _, h in term_hashes(np.frombuffer(_bytes(text), dtype=np.uint8))]
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def postings(cells: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text (repeats counted), and (term, text, occurrences) of the vocabulary's, by term and text."""
    data = np.frombuffer(b"\n".join(cells), dtype=np.uint8)
    first = np.cumsum([0, *(len(c) + 1 for c in cells[:-1])])
    length, found = np.zeros(len(cells), dtype=np.int64), []
    for start, name in term_hashes(data):
        text = np.searchsorted(first, start, side="right") - 1
        length += np.bincount(text, minlength=len(cells))
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, name), len(vocabulary) - 1)
            hit = vocabulary[at] == name
            found.append(at[hit] * len(cells) + text[hit])
    code, n = np.unique(np.concatenate(found) if found else np.empty(0, dtype=np.int64), return_counts=True)
    return length, code // len(cells), code % len(cells), n


# -- index ------------------------------------------------------------------------------

_INDEX = "ids array<{kind}>, lengths binary, term binary, doc binary, tf binary, n_docs long, n_terms long, seen array<int>, df array<int>"


def _index(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), DOCS):
                some = batch.slice(i, DOCS)
                cells = [_bytes(t) for t in some.column("text").to_pylist()]
                for low, high in by_bytes(cells, TEXT_BYTES):
                    yield block(some.column("doc_id").slice(low, high - low), cells[low:high])

    def block(ids: pa.Array, cells: list[bytes]) -> pa.RecordBatch:
        length, term, doc, tf = postings(cells, vocabulary)
        held, doc = np.unique(doc, return_inverse=True)
        seen, df = np.unique(term, return_counts=True)
        kept = ids.take(pa.array(held))
        raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), raw(length[held], np.int64), raw(term, np.int32), raw(doc, np.int32), raw(tf, np.int32),
             pa.array([int((length > 0).sum())]), pa.array([int(length.sum())]), ints(seen), ints(df)],
            ["ids", "lengths", "term", "doc", "tf", "n_docs", "n_terms", "seen", "df"])

    return run


# -- items ------------------------------------------------------------------------------

class Queries:
    """A block of items with the corpus counts: term weights, and each item's terms in pairs."""

    def __init__(self, items: list[np.ndarray], n_docs: int, n_terms: int, df: dict[int, int], size: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        often = np.array([df.get(i, 0) for i in range(size)], dtype=np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in often.tolist()], dtype=np.int64)
        number: dict[tuple[int, int], int] = {}
        self.items: list[np.ndarray] = []
        for terms in items:
            # Terms that no document has add nothing; neighbours in frequency form pairs, a last one stays alone.
            here = terms[(often[terms] > 0) & (self.weight[terms] > 0)]
            here = here[np.lexsort((here, often[here]))].tolist()
            pairs = [(a, b) for a, b in zip(here[::2], here[1::2])] + ([(here[-1], -1)] if len(here) % 2 else [])
            self.items.append(np.array([number.setdefault(p, len(number)) for p in pairs], dtype=np.int64))
        self.pairs = list(number)


class Block:
    """A block of the index, made ready for all items: impacts, pairs' intersection lists and bounds."""

    def __init__(self, row: dict, queries: Queries):
        raw = lambda c, kind: np.frombuffer(row[c], dtype=kind).astype(np.int64)
        term, self.doc, tf = raw("term", np.int32), raw("doc", np.int32), raw("tf", np.int32)
        m = 100 - 90 + (90 * raw("lengths", np.int64) * queries.n_docs) // max(1, queries.n_terms)
        self.size = len(m)
        self.impact = queries.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        edge = np.searchsorted(term, np.arange(len(queries.weight) + 1))
        self.list = [(int(a), int(b)) for a, b in zip(edge, edge[1:])]
        most = [int(self.impact[a:b].max()) if b > a else 0 for a, b in self.list]
        n = len(queries.pairs)
        self.single, self.joint, self.both = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        self.pairs = queries.pairs
        other = np.zeros(self.size, dtype=np.int64)
        for p, (a, b) in enumerate(queries.pairs):
            self.single[p] = max(most[a], most[b] if b >= 0 else 0)
            if b >= 0 and most[a] and most[b]:
                docs, mine = self.postings(a)
                other[docs] = mine
                docs_b, mine_b = self.postings(b)
                with_a = other[docs_b]
                hit = with_a > 0
                if hit.any():
                    self.both[p], self.joint[p] = docs_b[hit], int((with_a[hit] + mine_b[hit]).max())
                other[docs] = 0
        self.bound = np.maximum(self.single, self.joint)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.list[term]
        return self.doc[a:b], self.impact[a:b]

    def candidates(self, pairs: np.ndarray, least: int) -> np.ndarray:
        """Documents whose bound reaches ``least``."""
        apart = int(self.single[pairs].sum())
        if apart < least:  # only documents with a whole pair can get there
            bound = np.full(self.size, apart, dtype=np.int64)
            for p in pairs:
                if self.both[p] is not None and self.joint[p] > self.single[p]:
                    bound[self.both[p]] += self.joint[p] - self.single[p]
            return np.flatnonzero(bound >= least)
        order = pairs[np.argsort(self.bound[pairs], kind="stable")]
        essential = order[np.cumsum(self.bound[order]) >= least]
        held = np.zeros(self.size, dtype=bool)
        for p in essential:
            for t in self.pairs[p]:
                if t >= 0:
                    held[self.postings(t)[0]] = True
        return np.flatnonzero(held)

    def search(self, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of at least the score ``least`` (1 or more), and their scores."""
        if int(self.bound[pairs].sum()) < least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs = self.candidates(pairs, least)
        score = np.zeros(len(docs), dtype=np.int64)
        order = pairs[np.argsort(-self.bound[pairs], kind="stable")]
        ahead = int(self.bound[order].sum())
        for p in order:
            if not len(docs):
                break
            ahead -= int(self.bound[p])
            for t in self.pairs[p]:
                if t >= 0:
                    where, impact = self.postings(t)
                    if len(where):
                        at = np.minimum(np.searchsorted(where, docs), len(where) - 1)
                        score += np.where(where[at] == docs, impact[at], 0)
            alive = score + ahead >= least
            if not alive.all():
                docs, score = docs[alive], score[alive]
        return docs, score


def _search(sent, top: int, kind: pa.DataType):
    """The ``top`` best documents of each item over all blocks of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        best: list[list[tuple]] = [[] for _ in queries.items]  # (-score, id is null, id), best first
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in ("lengths", "term", "doc", "tf")}
                block, ids = Block(row, queries), batch.column("ids")[i].values
                if not block.size:
                    continue
                rank = np.empty(block.size, dtype=np.int64)
                rank[np.asarray(pc.sort_indices(ids))] = np.arange(block.size)  # nulls last
                for item, pairs in enumerate(queries.items):
                    if not len(pairs):
                        continue
                    held = best[item]
                    least = -held[-1][0] if len(held) == top else 1
                    docs, score = block.search(pairs, least)
                    if len(docs):
                        order = np.lexsort((rank[docs], -score))[:top]
                        new = [(-int(s), x is None, x) for s, x in zip(score[order], ids.take(pa.array(docs[order])).to_pylist())]
                        best[item] = sorted(held + new, key=lambda h: h[:2] if h[1] else h)[:top]
        rows = [(item, x, -s) for item, held in enumerate(best) for s, _, x in held]
        if rows:
            item, ids, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


# -- Spark ------------------------------------------------------------------------------

def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score."""
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = [_ranked(docs, [(r["item_id"], r["text"]) for r in items.where(deal == block).collect()], items.schema["item_id"].dataType, top)  # one block, bounded
             for block in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _ranked(docs: DataFrame, items: list[tuple], id_type, top: int) -> DataFrame:
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    terms = [item_terms(text) for _, text in items]
    vocabulary = np.unique(np.concatenate(terms)) if terms else np.empty(0, dtype=np.uint64)
    index = cut(docs.select("doc_id", "text").mapInArrow(_index(vocabulary), _INDEX.format(kind=kind)))
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    counts = index.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy("x.seen").agg(F.sum("x.df").alias("df"))
    df = {r["seen"]: r["df"] for r in counts.collect()}  # a row for each term of the item block
    queries = Queries([np.searchsorted(vocabulary, t) for t in terms], n_docs, n_terms, df, len(vocabulary))
    sent = spark.sparkContext.broadcast(queries)
    hits = index.select("ids", "lengths", "term", "doc", "tf").mapInArrow(_search(sent, top, to_arrow_type(docs.schema["doc_id"].dataType)), f"item int, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, item_id {id_type.simpleString()}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of ``documents`` for each item of ``benchmark``."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every document's score for every item that shares a term.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dt AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT r, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY r),
g AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM len),
df AS (SELECT term, count(*)::BIGINT AS df FROM c GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, g),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
s AS (SELECT q.item_id, q.text, c.r, c.doc_id, sum(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * len.n * g.nn) // g.ll))))::BIGINT AS score
      FROM q JOIN c USING (term) JOIN w USING (term) JOIN len ON len.r = c.r, g GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
