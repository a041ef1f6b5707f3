"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad.  A line's features are sixteen measures of
its characters and words, each cut into bins; its score for "good" adds a weight
for its own bins and for those of the lines before and after it.  Transitions
link neighbouring labels.  Training maximises the conditional likelihood of the
document's label on all its lines, with gradients from forward-backward.  A
document's quality is the mean of its lines' marginals P(good), weighted by line
length, put through a logistic curve fitted on documents that the training left
out.

Training rows: a bounded sample of about ``SAMPLE`` labelled documents (rows whose
hash lies below a threshold; documents of over ``MAX_LINES`` lines are not used for
training, but scored like all others).  The weights have a fixed size and are
broadcast.  Whole texts are scored.

Defined results: a null text counts as empty; an empty text is one empty line;
lines of over 2**20 bytes count as several lines of at most that many; rows
equal in all columns are scored each; extra columns are passed over; without any
labelled row all scores are 0.5; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import Rolling, crc32_of_id, mix64, released, table, word_bounds

SAMPLE, MAX_LINES, THRESHOLD = 6000, 400, 0.3
LINE_BYTES = 1 << 20
# Upper edges of the bins of each measure; below the first edge is bin 0.
RATIO = (1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.55, 0.8)
EDGES = {
    "bytes": (1, 20, 50, 100, 200, 400, 1000, 3000),
    "words": (1, 3, 6, 12, 25, 50, 100, 300),
    "letters": (0.3, 0.5, 0.65, 0.75, 0.8, 0.85, 0.9, 0.97),
    "upper": RATIO,
    "digits": RATIO,
    "symbols": RATIO,
    "exclaims": RATIO,
    "bars": RATIO,
    "sentence": RATIO,
    "distinct": (0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95, 1.0),
    "repeats": RATIO,
    "word_bytes": (1.5, 2.5, 3.5, 4.5, 5.5, 7, 9, 14),
    "longest": (3, 6, 9, 12, 16, 24, 40, 80),
    "seen": (0.5, 1.5, 2.5, 3.5, 4.5, 8.5, 16.5, 64.5),
    "closed": (0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5),
    "high": RATIO,
}
N, BINS = len(EDGES), 10  # nine bins and one for "no such line"

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 lower, 2 upper, 3 digit, 4 symbol, 5 !, 6 |, 7 sentence mark, 8 white space, 9 byte of a longer character
for _kind, _chars in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, "#$%&*+/<=>@[\\]^_`{}~"), (5, "!"), (6, "|"), (7, ".,;:?'\"()-"), (8, " \t\n\r\x0b\x0c")):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128:] = 9


# -- features -------------------------------------------------------------------------

def _measures(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of some lines of ``data`` (not yet ``seen``), and a fingerprint of each line."""
    n = len(start)
    low, high = int(start[0]), int(end[-1])
    part, start, end = data[low:high], start - low, end - low
    size = (end - start).astype(float)
    kinds = _CLASS[part]
    total = lambda mask: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(mask)])).astype(float)
    share = lambda mask: total(mask) / np.maximum(size, 1)
    roll = Rolling(part)
    w0, w1 = word_bounds(part)
    line = np.searchsorted(start, w0, side="right") - 1
    # A word may end only where its line does: line feeds are white space, forced cuts are not.
    w1 = np.minimum(w1, end[line]) if len(line) else w1
    words = np.bincount(line, minlength=n).astype(float)
    name = roll.at(w0, w1)
    key = mix64(name + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    distinct = np.bincount(line[order][fresh], minlength=n)
    again = np.zeros(len(line), dtype=bool)
    again[1:] = (name[1:] == name[:-1]) & (line[1:] == line[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, line, w1 - w0)
    closed = np.zeros(n)
    full = size > 0
    closed[full] = np.isin(part[end[full] - 1], np.frombuffer(b".?!:;\"'", dtype=np.uint8))
    values = np.column_stack([
        size, words, share((kinds == 1) | (kinds == 2) | (kinds == 9)), share(kinds == 2), share(kinds == 3), share(kinds == 4), share(kinds == 5), share(kinds == 6),
        share(kinds == 7), distinct / np.maximum(words, 1), np.bincount(line, weights=again, minlength=n) / np.maximum(words, 1),
        np.bincount(line, weights=w1 - w0, minlength=n) / np.maximum(words, 1), longest, np.zeros(n), closed, share(kinds == 9)])
    return values, roll.at(start, end)


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins (lines x measures) and lengths of a text's lines."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    cut = np.flatnonzero(data == 10)
    start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(data)]])
    if (end - start).max() > LINE_BYTES:
        spans = [(a, min(a + LINE_BYTES, e)) for s, e in zip(start, end) for a in range(s, max(e, s + 1), LINE_BYTES)]
        start, end = (np.array(x) for x in zip(*spans))
    values, names, at = [], [], 0
    while at < len(start):  # about LINE_BYTES at a time
        to = max(at + 1, int(np.searchsorted(end, start[at] + LINE_BYTES, side="right")))
        v, name = _measures(data, start[at:to], end[at:to])
        values.append(v)
        names.append(name)
        at = to
    values, names = np.concatenate(values), np.concatenate(names)
    _, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
    values[:, list(EDGES).index("seen")] = count[inverse]
    bins = np.column_stack([np.searchsorted(e, values[:, i], side="right") for i, e in enumerate(EDGES.values())]).astype(np.uint8)
    return bins, np.maximum(end - start, 1).astype(float)


# -- the chain -------------------------------------------------------------------------

@dataclass
class Chain:
    weight: np.ndarray = field(default_factory=lambda: np.zeros((3, N, BINS)))  # line before, own, after
    link: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0


def _neighbours(bins: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Bins of the line before, the line itself and the line after, within each document."""
    first, last = np.cumsum(length) - length, np.cumsum(length) - 1
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    before[first], after[last] = BINS - 1, BINS - 1
    return [before, bins, after]


def _scores(chain: Chain, near: list[np.ndarray]) -> np.ndarray:
    cols = np.arange(N)
    return np.clip(sum(chain.weight[k][cols, b].sum(axis=1) for k, b in enumerate(near)), -30, 30)


def forward_backward(score: np.ndarray, length: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(good) of all lines, and expected counts of label pairs.

    ``score`` holds the documents' lines end to end; all documents advance
    together, longest first, so that the ones still running are a prefix.
    """
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    running = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), side="right")
    step = np.exp(link)
    emit = np.column_stack([np.ones(len(score)), np.exp(score)])
    emit /= emit.sum(axis=1, keepdims=True)
    alpha, beta = np.empty((len(score), 2)), np.ones((len(score), 2))
    for t, n in enumerate(running):
        at = first[:n] + t
        a = emit[at] * (alpha[at - 1] @ step if t else 1.0)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(running) - 2, -1, -1):
        at = first[:running[t + 1]] + t
        onward = emit[at + 1] * beta[at + 1]
        b = onward @ step.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
        pair = alpha[at][:, :, None] * step * onward[:, None, :]
        pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), pairs


def quality(chain: Chain, bins: np.ndarray, length: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length-weighted marginals of documents whose lines lie end to end."""
    good, _ = forward_backward(_scores(chain, _neighbours(bins, length)), length, chain.link)
    doc = np.repeat(np.arange(len(length)), length)
    return np.bincount(doc, weights=good * size) / np.bincount(doc, weights=size)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def train(docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 250, batch: int = 256, rate: float = 0.05, ridge: float = 1e-3, seed: int = 5) -> Chain:
    """Weights of greatest conditional likelihood, by Adam on batches of documents."""
    chain, rng = Chain(), np.random.default_rng(seed)
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in (chain.weight, chain.link)]
    for step in range(1, steps + 1):
        some = rng.choice(len(docs), min(batch, len(docs)), replace=False)
        length = np.array([len(docs[i][0]) for i in some])
        near = _neighbours(np.concatenate([docs[i][0] for i in some]), length)
        good, pairs = forward_backward(_scores(chain, near), length, chain.link)
        y = np.repeat(label[some], length)
        # A long document weighs as much as a short one.
        each = np.repeat(1 / length, length)
        miss = (y - good) * each
        up = np.stack([np.stack([np.bincount(b[:, j], weights=miss, minlength=BINS) for j in range(N)]) for b in near]) / len(some)
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = (length[label[some] == k] - 1).sum()
        move = (seen - pairs) / max(1, length.sum())
        for x, g, (m, v) in zip((chain.weight, chain.link), (up - ridge * chain.weight, move - 0.05 * chain.link), moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return chain


def calibrate(chain: Chain, raw: np.ndarray, label: np.ndarray) -> None:
    """Logistic curve over the weighted marginals' log odds (Newton's method, a little ridge)."""
    if len(set(label.tolist())) < 2:
        return
    x = np.column_stack([np.clip(logit(raw), -8, 8), np.ones(len(raw))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (label - p) - 0.1 * (w - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w + np.linalg.solve(h, g)
    chain.slope, chain.shift = float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """Chain learned from about ``sample`` labelled documents (doc_id, quality 0 or 1).

    Repeated labels and documents count once.
    """
    labels = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = labels.count()
    if not n:
        return None
    share = int(min(1.0, sample / n) * (1 << 30))
    some = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) < share)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded: about ``sample`` rows of two numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, label in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), batch.column("quality").to_pylist()):
                if (text or "").count("\n") < MAX_LINES:
                    out.append((doc_id, label, *(x.tobytes() for x in line_features(text))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["fold", "label", "bins", "size"])

    # Bounded: ``sample`` documents of at most MAX_LINES lines, 24 bytes a line.
    got = sorted(((r["fold"], r["label"], bytes(r["bins"]), bytes(r["size"])) for r in
                  texts.select(F.xxhash64("doc_id", F.lit(29)).alias("fold"), "text", "quality").groupBy("fold", F.xxhash64("text").alias("_text")).agg(F.first("text").alias("text"), F.first("quality").alias("quality")).drop("_text").mapInArrow(released(features), "fold long, label int, bins binary, size binary").collect()))
    if not got:
        return None
    lines = [(np.frombuffer(r[2], dtype=np.uint8).reshape(-1, N), np.frombuffer(r[3])) for r in got]
    y, apart = np.array([float(r[1]) for r in got]), np.array([r[0] % 4 == 0 for r in got])
    if apart.all() or not apart.any():
        apart = np.zeros(len(got), dtype=bool)
    chain = train([d for d, a in zip(lines, apart) if not a], y[~apart])
    rest = [d for d, a in zip(lines, apart) if a] or lines
    raw = quality(chain, np.concatenate([d[0] for d in rest]), np.array([len(d[0]) for d in rest]), np.concatenate([d[1] for d in rest]))
    calibrate(chain, raw, y[apart] if apart.any() else y)
    return chain


def score(docs: DataFrame, chain: Chain | None, extra: bool = False) -> DataFrame:
    """``doc_id`` and ``score`` of all documents; with ``extra`` their other columns as well."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    docs = docs.drop("score") if extra else docs.select("doc_id", "text")
    keep = docs.columns if extra else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                if not len(part):
                    continue
                if chain is None:
                    p = np.full(len(part), 0.5)
                else:
                    bins, size = zip(*(line_features(x.as_py()) for x in part.column("text")))
                    raw = quality(chain, np.concatenate(bins), np.array([len(b) for b in bins]), np.concatenate(size))
                    p = 1 / (1 + np.exp(-(chain.slope * np.clip(logit(raw), -8, 8) + chain.shift)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(p)], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep)
    return docs.mapInArrow(released(run), f"{fields}, score double")


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of ``documents``, learned from labels whose crc32(doc_id) mod 5 is not 0."""
    docs, held_out = table(spark, sf_dir, "documents"), F.pmod(crc32_of_id(), F.lit(5)) == 0
    chain = fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, chain).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
