"""Exact substring dedup with longest-previous-factor arrays.

A string of ``min_bytes`` bytes is a repeat if it starts at two places of the
corpus.  The longest previous factor (LPF) of a place is the length of its
longest match with an earlier place; in suffix order that match is found at the
previous or the next entry with a smaller position.  Only whether LPF reaches
``min_bytes`` matters, so suffixes are compared by their first ``min_bytes``
bytes, and the suffix array of the whole corpus is dealt out in buckets:

1. *Anchors.*  Of the k-byte substrings in each ``min_bytes``-byte window the
   (leftmost) least fingerprint is the window's anchor.  Equal windows have
   equal anchors at equal offsets, so suffixes that can match meet in the
   bucket of their anchor's fingerprint.  Neighbouring windows share an anchor:
   a *run*.  About one place in 120 is an anchor.
2. Anchors that occur once in the corpus cannot be in a repeat; counts per
   fingerprint (partial sums before the shuffle) drop them.
3. Runs that are equal as a whole are counted; a run that occurs twice is a
   repeat everywhere.  Only one of each set of equal runs goes on.
4. *Buckets.*  For the others the bytes are fetched and the suffixes starting
   in the runs of one bucket are put in suffix order by their bytes (prefix
   doubling); the longer of the matches with the entries at the previous and the next
   smaller position is the LPF.  Where all copies go, the first of them lies beside the
   others in suffix order.
5. A bucket of more than ``WIDE`` bytes is not held by one task: its suffixes become
   rows that Spark groups by their fingerprint, which gives the same answer with
   partial aggregation, but no order and no lengths.

With ``min_words``, strings of so many words are judged too, by the same steps on
each text's sequence of word fingerprints in place of its bytes: places, windows
and spans count words, whatever white space lies between them.  Each maximal run
of words in such repeats goes from its first word's first byte to its last word's
last byte.

``keep="first"`` removes later copies and keeps the first (in order of doc_id,
then text hash, then offset); ``keep="none"`` removes every copy.  Strings are
judged on the input, not on what is left.

Defined results: a null text counts as empty; matches never cross documents;
texts shorter than ``min_bytes`` (and ``min_words``) are never touched; rows equal in doc_id and
text are one document for the order of copies (with ``keep="first"`` all of
them stay, with ``keep="none"`` all of them go); a null doc_id sorts first;
input columns named like an output column are replaced; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.llm.common import Rolling, cut, mix64, released, row_key, table, word_bounds, word_hashes

MIN_BYTES = 400
ANCHOR_BYTES = 160
ANCHOR_WORDS = 20
#: Most bytes (or words) of the different runs of one bucket that a task puts in suffix order itself.
WIDE = 4 << 20
#: Bytes of a document that are fingerprinted at a time, bytes of runs sent at a time, and bytes of buckets
#: ordered at a time (few: sorting is quicker while all numbers lie in a processor's cache).
CHUNK, BATCH, ORDERED = 1 << 20, 2 << 20, 1 << 18


# -- numpy core -----------------------------------------------------------------

def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its leftmost least value."""
    val, pos, n = values, np.arange(len(values), dtype=np.int32), 1
    while n < width:
        step = min(n, width - n)
        right = val[step:] < val[:-step]
        val = np.where(right, val[step:], val[:-step])
        pos = np.where(right, pos[step:], pos[:-step])
        n += step
    return pos


def smaller_neighbours(values: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next place with a smaller value within the same run (-1: none).

    ``run`` is non-decreasing.  Pointers jump over larger values until they
    rest on a smaller one or leave the run.
    """
    def previous(v: np.ndarray, r: np.ndarray) -> np.ndarray:
        to = np.arange(-1, len(v) - 1)
        if len(v):
            to[1:][r[1:] != r[:-1]] = -1
        todo = np.flatnonzero(to >= 0)
        todo = todo[v[to[todo]] >= v[todo]]
        while len(todo):
            to[todo] = to[to[todo]]
            todo = todo[to[todo] >= 0]
            todo = todo[v[to[todo]] >= v[todo]]
        return to

    back = previous(values[::-1], run[::-1])[::-1]
    return previous(values, run), np.where(back < 0, -1, len(values) - 1 - back)


def anchors(data: np.ndarray, min_bytes: int, anchor_bytes: int):
    """Runs of a text: anchor place, first window, number of windows, anchor and run fingerprint."""
    out = []
    for base in range(0, len(data) - min_bytes + 1, CHUNK):
        part = data[base:base + CHUNK + min_bytes - 1]
        roll = Rolling(part)
        grams = roll.all(anchor_bytes)
        at = leftmost_min(grams, min_bytes - anchor_bytes + 1)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        count = np.diff(np.concatenate([first, [len(at)]]))
        place = at[first]
        whole = mix64(roll.at(first, first + count + (min_bytes - 1)) + (place - first).astype(np.uint64))
        out.append((place + base, first + base, count, grams[place], whole))
    return [np.concatenate(x) for x in zip(*out)] if out else None


class Suffixes:
    """Suffix order and common prefixes by prefix doubling, up to a length.

    ``levels`` holds, for lengths 1, 2, 4 and so on, a number for the units that follow
    each place: equal numbers for equal units, in their order.  Suffixes that end
    before such a length have no number there and are not asked for it.
    """

    def __init__(self, data: np.ndarray, length: int):
        self.length, step = length, 1
        self.levels = [data.astype(np.uint32) if data.dtype == np.uint8 else self._ranks(data)]
        while 2 * step <= length:
            last = self.levels[-1]
            front, back = last[:max(0, len(last) - step)], last[step:]
            if data.dtype == np.uint8 and step < 4:  # up to four bytes are their own number
                self.levels.append(front << np.uint32(8 * step) | back)
            else:
                self.levels.append(self._ranks(front.astype(np.uint64) << np.uint64(32) | back.astype(np.uint64)))
            step *= 2

    @staticmethod
    def _ranks(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values)
        along = values[order]
        out = np.empty(len(values), dtype=np.uint32)
        if len(values):
            out[order] = np.cumsum(np.concatenate([[False], along[1:] != along[:-1]]), dtype=np.uint32)
        return out

    def order(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Suffix order, by bucket, of the suffixes at ``start``: by their first ``length`` units."""
        step = 1 << (len(self.levels) - 1)
        top = self.levels[-1]
        key = top[start].astype(np.uint64) << np.uint64(32) | top[start + self.length - step].astype(np.uint64)
        return np.lexsort((key, bucket))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of suffixes, ``length`` at most."""
        out = np.zeros(len(a), dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            fits = np.flatnonzero(out + step <= self.length)
            same = fits[rank[a[fits] + out[fits]] == rank[b[fits] + out[fits]]]
            out[same] += step
        return out


def previous_factors(suffixes: Suffixes, order: np.ndarray, start: np.ndarray, bucket: np.ndarray, position: np.ndarray) -> np.ndarray:
    """LPF of the suffixes at ``start``: the longest match with one of a smaller position in its bucket, ``length`` at most."""
    out = np.zeros(len(start), dtype=np.int64)
    for near in smaller_neighbours(position[order], bucket[order]):
        some = np.flatnonzero(near >= 0)
        out[order[some]] = np.maximum(out[order[some]], suffixes.common(start[order[some]], start[order[near[some]]]))
    return out


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a set of half-open spans (touching ones are joined)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], end[last]


# -- Arrow plumbing ---------------------------------------------------------------

def _bytes(cell) -> np.ndarray:
    return np.frombuffer((cell or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _units(cell, words: bool) -> np.ndarray:
    """A text's bytes, or its words' fingerprints."""
    return word_hashes(_bytes(cell))[1] if words else _bytes(cell)


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary cell per count, holding so many of the (int32) values."""
    offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, dtype=np.int32))])


def _span_rows(key: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    spans = np.column_stack([start, end]).astype(np.int32).ravel()
    return pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), _binary(spans, np.full(len(start), 2))], ["_hd", "_ht", "at"])


_SPANS = "_hd long, _ht long, at binary"


def _anchor_rows(min_bytes: int, anchor_bytes: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hd, ht = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_hd", "_ht"))
            ids, rows, pending = batch.column("doc_id"), [], 0
            for i in range(len(batch)):
                found = anchors(_units(batch.column("text")[i].as_py(), words), min_bytes, anchor_bytes)
                if found is None:
                    continue
                place, first, count, gram, whole = found
                # One row for equal runs of the same document, with all their places.
                same = mix64(gram + whole * np.uint64(3))
                order = np.argsort(same, kind="stable")
                head = np.flatnonzero(np.concatenate([[True], np.diff(same[order]) != 0]))
                occurs = np.diff(np.concatenate([head, [len(order)]]))
                at = np.column_stack([place, first, count])[order].astype(np.int32)
                rows.append((np.full(len(head), i), gram[order][head], whole[order][head], occurs, at))
                pending += len(order)
                if pending > 200_000:
                    yield _pack(rows, ids, hd, ht)
                    rows, pending = [], 0
            if rows:
                yield _pack(rows, ids, hd, ht)

    def _pack(rows, ids, hd, ht):
        row, gram, whole, occurs, at = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), ids.take(pa.array(row)), pa.array(hd[row]), pa.array(ht[row]),
             pa.array(occurs.astype(np.int32)), _binary(at.ravel(), occurs * 3)],
            ["gram", "whole", "doc_id", "_hd", "_ht", "occurs", "at"])

    return run


def _run_bytes(min_bytes: int, words: bool):
    """The bytes (or word fingerprints) of the wanted runs of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text, doc_id, hd, ht, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "doc_id", "_hd", "_ht", "wanted"))):
                data = _units(text, words)
                for x in wanted:
                    piece = data[x["first"]:x["first"] + x["windows"] + min_bytes - 1].tobytes()
                    rows.append((x["gram"], doc_id, hd, ht, x["first"], x["windows"], x["place"], x["alone"], piece))
                    size += len(piece)
                    if size > BATCH:
                        yield _pack(rows, batch.schema)
                        rows, size = [], 0
            if rows:
                yield _pack(rows, batch.schema)

    def _pack(rows, schema):
        kinds = [pa.int64(), schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = ["gram", "doc_id", "_hd", "_ht", "first", "windows", "place", "alone", "bytes"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def _windows(batch, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes (or word fingerprints) of all runs of a batch end to end; of each window the start there and the row."""
    pieces = batch.column("bytes").combine_chunks() if isinstance(batch, pa.Table) else batch.column("bytes")
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int32, count=len(pieces) + pieces.offset + 1)[pieces.offset:]
    data = np.frombuffer(pieces.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    if words:
        data, offsets = data.view(np.uint64), offsets // 8
    windows = batch.column("windows").to_numpy()
    row = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return data, offsets[:-1][row] + inside, row


def _bucket_spans(min_bytes: int, keep: str, words: bool):
    """Spans of repeats in the runs of whole buckets, which arrive in order of bucket and position."""
    def solve(t: pa.Table) -> pa.RecordBatch:
        data, start, row = _windows(t, words)
        gram = t.column("gram").to_numpy()
        bucket = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]]))[row]
        suffixes = Suffixes(data, min_bytes)
        order = suffixes.order(start, bucket)
        # Rows come in order of position; rows equal in id and text bring the same run, which is one place.
        names = [t.column(c).to_numpy() for c in ("gram", "_hd", "_ht", "first")]
        place = np.cumsum(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in names], axis=0)]))
        inside = np.arange(len(row)) - np.repeat(np.cumsum(t.column("windows").to_numpy()) - t.column("windows").to_numpy(), t.column("windows").to_numpy())
        position = (place[row] << 32) + inside
        repeat = previous_factors(suffixes, order, start, bucket, position) >= min_bytes
        if keep == "none":
            # Equal suffixes lie together in suffix order: where one repeats an earlier one, all of them go.
            with_next = suffixes.common(start[order[:-1]], start[order[1:]]) >= min_bytes
            group = np.cumsum(np.concatenate([[True], ~with_next | (bucket[order[1:]] != bucket[order[:-1]])])) - 1
            repeat[order] = np.bincount(group, weights=repeat[order])[group] > 0
            repeat &= t.column("alone").to_numpy()[row]
        hit = np.flatnonzero(repeat)
        if not len(hit):
            return _span_rows([np.empty(0, np.int64)] * 2, hit, hit)
        base = np.cumsum(t.column("windows").to_numpy()) - t.column("windows").to_numpy()
        at = t.column("first").to_numpy()[row[hit]] + hit - base[row[hit]]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)]))
        tail = np.concatenate([head[1:] - 1, [len(hit) - 1]])
        return _span_rows([t.column(c).to_numpy()[row[hit[head]]] for c in ("_hd", "_ht")], at[head], at[tail] + min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in (b.slice(i, 200) for b in batches for i in range(0, len(b), 200)):
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held.nbytes < ORDERED:
                continue
            gram = held.column("gram").to_numpy()
            whole = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
            if whole:
                yield solve(held.slice(0, whole).combine_chunks())
                held = held.slice(whole).combine_chunks()
        if held is not None and len(held):
            yield solve(held.combine_chunks())

    return run


def _window_rows(min_bytes: int, words: bool):
    """A row for each suffix of the runs of wide buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                if not len(part):
                    continue
                data, start, row = _windows(pa.Table.from_batches([part]).combine_chunks(), words)
                windows = part.column("windows").to_numpy()
                at = part.column("first").to_numpy()[row] + np.arange(len(row)) - (np.cumsum(windows) - windows)[row]
                name = Rolling(data).at(start, start + min_bytes)
                take = lambda c: part.column(c).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([take("gram"), pa.array(name.view(np.int64)), take("doc_id"), take("_hd"), take("_ht"), pa.array(at.astype(np.int32)), take("alone")],
                                                 ["gram", "name", "doc_id", "_hd", "_ht", "start", "alone"])

    return run


def _run_spans(min_bytes: int):
    """Spans of the runs that are repeats as a whole; ``skip`` names one that stays.

    A row for each document of a batch, with its spans merged.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            counts = batch.column("occurs").to_numpy()
            at = np.frombuffer(b"".join(batch.column("at").to_pylist()), dtype=np.int32).reshape(-1, 3)
            row = np.repeat(np.arange(len(batch)), counts)
            stay = batch.column("skip").to_numpy(zero_copy_only=False)[row] == at[:, 1]
            row, at = row[~stay], at[~stay]
            if not len(row):
                continue
            hd, ht = (batch.column(c).to_numpy()[row] for c in ("_hd", "_ht"))
            order = np.lexsort((ht, hd))
            hd, ht, at = hd[order], ht[order], at[order].astype(np.int64)
            new = np.concatenate([[True], (hd[1:] != hd[:-1]) | (ht[1:] != ht[:-1])])
            # Documents lie 2**32 apart on one line, so all are merged at once.
            base = (np.cumsum(new) - 1) << 32
            start, end = merge_spans(at[:, 1] + base, at[:, 1] + at[:, 2] + (min_bytes - 1) + base)
            spans = np.column_stack([start, end]) & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array(hd[new]), pa.array(ht[new]), _binary(spans.ravel(), 2 * np.bincount(start >> 32))], ["_hd", "_ht", "at"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The maximal removed runs of each document and its remaining bytes, beside its columns."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for i in range(0, len(batch), 64):  # few texts at a time are held twice
            part = batch.slice(i, 64)
            spans, kept = [], []
            for text, cells, in_words in zip(*(part.column(c).to_pylist() for c in ("text", "_at", "_words"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                if not cells and not in_words:
                    spans.append([])
                    kept.append(data)
                    continue
                pairs = np.frombuffer(b"".join(cells), dtype=np.int32).reshape(-1, 2)
                if in_words:
                    first, last = merge_spans(*np.frombuffer(b"".join(in_words), dtype=np.int32).reshape(-1, 2).T)
                    start, end = word_bounds(np.frombuffer(data, dtype=np.uint8))
                    pairs = np.concatenate([pairs, np.column_stack([start[first], end[last - 1]])])
                start, end = (x.tolist() for x in merge_spans(pairs[:, 0], pairs[:, 1]))
                spans.append([{"start": a, "end": b} for a, b in zip(start, end)])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *end], [*start, len(data)])))
            keep = [c for c in part.schema.names if c not in ("_at", "_words")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(spans, kind), pa.array(kept, pa.binary())], [*keep, "spans", "kept"])


# -- Spark ------------------------------------------------------------------------

def repeat_spans(keyed: DataFrame, min_bytes: int, keep: str, anchor_bytes: int, wide: int, words: bool = False) -> DataFrame:
    """Spans (``at``) to remove from the documents (``_hd``, ``_ht``); with ``words``, all lengths and places count words."""
    if not 0 < anchor_bytes <= min_bytes:
        raise ValueError("an anchor is between 1 and the length of a repeat")
    key = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, _hd long, _ht long"
    rows = f"gram long, whole long, {key}, occurs int, at binary"
    least = 2 * min_bytes - 1 if words else min_bytes  # bytes
    runs = (keyed.where(F.octet_length("text") >= least).select("doc_id", "text", "_hd", "_ht")
            .mapInArrow(released(_anchor_rows(min_bytes, anchor_bytes, words)), rows))

    # Anchors that occur more than once; the rest of the corpus needs no further look.
    # Stored, so that the join's two sides are plain shuffles and Spark can split a hot anchor.
    often = cut(runs.groupBy("gram").agg(F.sum("occurs").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
             .where("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")))
    runs = cut(runs.join(often, "gram"))

    # Equal runs: how many, and the first of them.
    place = lambda i: F.conv(F.concat(*(F.hex(F.substring("at", 4 * i + j, 1)) for j in (4, 3, 2, 1))), 16, 10).cast("int")  # noqa: E731  little-endian
    me = F.struct("doc_id", "_ht", F.col("_first"), "_hd", F.col("_place"), F.col("_windows"))
    equal = cut(runs.withColumns({"_place": place(0), "_first": place(1), "_windows": place(2)})
             .groupBy("gram", "whole", "mixed").agg(F.sum("occurs").alias("n"), F.min(me).alias("top")))
    judged = runs.join(equal.select("gram", "whole", "n", "top"), ["gram", "whole"])
    is_top = (F.col("_hd") == F.col("top._hd")) & (F.col("_ht") == F.col("top._ht"))
    skip = F.when(is_top, F.col("top._first")).otherwise(-1) if keep == "first" else F.lit(-1)
    spans = judged.where("n > 1").select("_hd", "_ht", "occurs", "at", skip.alias("skip")).mapInArrow(released(_run_spans(min_bytes)), _SPANS)

    # One of each set of equal runs, where a bucket holds different ones.
    singles = equal.where("mixed").select("gram", (F.col("n") == 1).alias("alone"), "top.*")
    breadth = singles.groupBy("gram").agg(F.sum(F.col("_windows") + F.lit(min_bytes - 1)).alias("breadth"), F.max("alone").alias("any_alone"))
    if keep == "none":  # equal runs are settled; a bucket matters if some run is alone in it
        breadth = breadth.where("any_alone")
    breadth = cut(breadth.drop("any_alone"))
    runs_type = f"gram long, {key}, first int, windows int, place int, alone boolean, bytes binary"

    def with_bytes(condition: str) -> DataFrame:
        some = singles.join(breadth.where(condition), "gram")
        wanted = (some.groupBy("_hd", "_ht").agg(F.collect_list(F.struct("gram", "alone", F.col("_first").alias("first"), F.col("_windows").alias("windows"), F.col("_place").alias("place"))).alias("wanted")))
        texts = keyed.select("doc_id", "text", "_hd", "_ht")
        return texts.join(wanted, ["_hd", "_ht"]).mapInArrow(released(_run_bytes(min_bytes, words)), runs_type)

    narrow = (with_bytes(f"breadth <= {int(wide)}").repartition(F.col("gram")).sortWithinPartitions("gram", "doc_id", "_ht", "first")
              .mapInArrow(released(_bucket_spans(min_bytes, keep, words)), _SPANS))
    spans = spans.unionByName(narrow)
    if not breadth.where(f"breadth > {int(wide)}").isEmpty():
        windows_type = f"gram long, name long, {key}, start int, alone boolean"
        each = with_bytes(f"breadth > {int(wide)}").mapInArrow(released(_window_rows(min_bytes, words)), windows_type)
        same = each.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_ht", "start", "_hd")).alias("top")).where("n > 1")
        gone = F.col("alone") if keep == "none" else ~((F.col("_hd") == F.col("top._hd")) & (F.col("_ht") == F.col("top._ht")) & (F.col("start") == F.col("top.start")))
        hits = each.join(same, ["gram", "name"]).where(gone).select("_hd", "_ht", "start")
        le = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c), 8, "0"), j, 2) for j in (7, 5, 3, 1))))
        spans = spans.unionByName(hits.select("_hd", "_ht", F.concat(le(F.col("start")), le(F.col("start") + min_bytes)).alias("at")))

    return spans


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "first", anchor_bytes: int = ANCHOR_BYTES, wide: int = WIDE,
                   min_words: int | None = None, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with ``spans`` (removed byte ranges, maximal, in order) and ``kept`` (remaining bytes).

    ``docs`` needs doc_id and text.  With ``min_words``, repeats of so many words
    go as well, however few bytes they have.  See the module's text for method
    and defined results.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    docs = docs.drop("spans", "kept", "_hd", "_ht", "_at", "_words")
    keyed = docs.select("*", *row_key())
    none = F.lit(None).cast("binary")
    spans = repeat_spans(keyed, min_bytes, keep, anchor_bytes, wide).withColumn("words", none)
    if min_words is not None:
        in_words = repeat_spans(keyed, min_words, keep, anchor_words, wide, words=True)
        spans = spans.unionByName(in_words.select("_hd", "_ht", none.alias("at"), F.col("at").alias("words")))

    per_doc = spans.groupBy("_hd", "_ht").agg(F.collect_list("at").alias("_at"), F.collect_list("words").alias("_words"))
    joined = keyed.join(per_doc, ["_hd", "_ht"], "left").drop("_hd", "_ht")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType(docs.schema.fields + [T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(released(_merged), out)


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c != "spans"]
        text = [t if not s else whole_characters(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(text, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in keep], keep)


def whole_characters(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the characters that lie wholly in the byte spans."""
    data = text.encode("utf-8", "surrogatepass")
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: E731  within a character
    out, at = [], 0
    for start, end in spans:
        while inside(start):
            start += 1
        while inside(end):
            end -= 1
        if end > start:
            out.append(data[at:start])
            at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES,
                min_words: int | None = None, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with later copies of repeats cut from the texts (whole characters only), the first kept.

    All rows stay; ``n_chars``, if there, is counted anew.
    """
    # The other columns go along under one name, whatever they are called.
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("_others")
    narrow = docs.select("doc_id", "text", others)
    done = remove_repeats(narrow, min_bytes, "first", anchor_bytes, min_words=min_words, anchor_words=anchor_words).select("doc_id", "text", "_others", "spans")
    done = done.mapInArrow(released(_cut_text), narrow.schema).select(*("text" if c == "text" else F.col("_others").getField(c).alias(c) for c in docs.columns))
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each byte of ``documents`` in a 400-byte string that starts twice goes, every copy of it."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_BYTES, keep="none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
