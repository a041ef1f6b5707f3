"""Language identification with averaged hashed subword embeddings.

Features of a text are its character n-grams (1 to 4, lower case, a word edge
counts as a character) hashed into 2**15 rows.  The text's vector is the mean of
their embeddings, a linear softmax gives the languages' probabilities.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy.  A temperature, fitted on rows the descent did not see, calibrates the
probabilities; a rejection threshold is the least score from which the accepted
of those rows reach a target precision.

Training rows: of each language, rows whose hash lies below a threshold that
makes about ``PER_LANGUAGE`` of them (a bound, at every corpus size), of each up to
``SEGMENTS`` pieces of ``SEGMENT_CHARS`` characters.  The model is 2**15 rows by the
number of languages; it goes to the tasks as one broadcast of that fixed size.
Every whole text is predicted.

Defined results: a text that is null or has no letter is ``und`` with score 0 (and
so is every text if there is no labelled row); languages tie in alphabetical
order; rows equal in all columns are predicted each; extra columns are passed
over; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import crc32_of_id, mix64, table

BUCKET_BITS, DIMENSION, ORDERS = 15, 16, (1, 2, 3, 4)
PER_LANGUAGE, SEGMENTS, SEGMENT_CHARS = 900, 4, 160
UNDETERMINED = "und"
#: Characters whose n-grams are hashed at a time.
CHUNK = 1 << 18

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def characters(text: str | None) -> np.ndarray:
    """Lower-case letters of a text as code points; each run of other characters is one 0."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where(_is_letter()[code], code, np.uint32(0))
    code = np.concatenate([[np.uint32(0)], code, [np.uint32(0)]])
    return code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]


def subwords(code: np.ndarray) -> np.ndarray:
    """Hash rows of the n-grams of a text's characters that do not reach across a word edge."""
    out = []
    for n in ORDERS:
        size = len(code) - n + 1
        if size < 1:
            continue
        h, ok = np.full(size, n, dtype=np.uint64), np.ones(size, dtype=bool)
        for i in range(n):
            part = code[i:i + size]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            if 0 < i < n - 1 or n == 1:
                ok &= part != 0
        if n == 2:
            ok = (code[:size] != 0) | (code[1:1 + size] != 0)
        out.append((mix64(h[ok]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def counts(text: str | None) -> np.ndarray | None:
    """How often each hash row occurs in the whole text; None if it has no letter."""
    code = characters(text)
    if not code.any():
        return None
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for i in range(0, len(code), CHUNK):
        total += np.bincount(subwords(code[i:i + CHUNK + max(ORDERS) - 1]), minlength=len(total))
    return total


# -- training -------------------------------------------------------------------------

@dataclass
class Model:
    languages: list[str]
    table: np.ndarray       # per hash row, the logits it adds to the mean
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        z = (mean_logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def train(rows: list[np.ndarray], label: np.ndarray, n_labels: int, steps: int = 800, batch: int = 64, rate: float = 0.8, seed: int = 7):
    """(embeddings, softmax weights, bias) by stochastic gradient descent on hashed rows.

    Each step draws its texts evenly from the languages, so rare ones count as much.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    emb = rng.normal(0, 0.1, (size, DIMENSION)).astype(np.float32)
    weight, bias = np.zeros((DIMENSION, n_labels), dtype=np.float32), np.zeros(n_labels, dtype=np.float32)
    of = [np.flatnonzero(label == k) for k in range(n_labels)]
    of = [x for x in of if len(x)]
    for step in range(steps):
        some = np.array([rng.choice(of[i]) for i in rng.integers(0, len(of), batch)])
        idx, length = np.concatenate([rows[i] for i in some]), np.array([len(rows[i]) for i in some])
        mean = np.add.reduceat(emb[idx], np.cumsum(length) - length, axis=0) / length[:, None]
        z = mean @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(some)), label[some]] -= 1
        p /= len(some)
        lr = rate * (1 - step / steps)
        back = (p @ weight.T) / length[:, None]
        spread = np.repeat(np.arange(len(some)), length)
        weight -= lr * mean.T @ p
        bias -= lr * p.sum(axis=0)
        for k in range(DIMENSION):  # rows share a mean: each gets its share of the gradient, scaled up by the batch's texts
            emb[:, k] -= lr * len(some) * np.bincount(idx, weights=back[spread, k], minlength=size).astype(np.float32)
    return emb, weight, bias


def calibrate(model: Model, logits: np.ndarray, label: np.ndarray, target: float) -> None:
    """Temperature of least log loss, and the least score whose accepted rows are right at the target rate."""
    if not len(label):
        return
    loss = []
    grid = np.geomspace(0.05, 20, 60)
    for t in grid:
        model.temperature = float(t)
        p = model.probabilities(logits)
        loss.append(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = model.probabilities(logits)
    score, right = p.max(axis=1), p.argmax(axis=1) == label
    order = np.argsort(-score, kind="stable")
    rate = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(rate >= target)
    model.threshold = float(score[order][good[-1]]) if len(good) else 1.0


def fit(labelled: DataFrame, label: str = "lang", per_label: int = PER_LANGUAGE, target: float = 0.99) -> Model:
    """Model learned from a bounded sample of the rows with text and a non-null ``label``.

    Rows equal in id and text count once, however often they are repeated.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col(label).isNotNull())
    n = {r[0]: r[1] for r in labelled.groupBy(label).agg(F.count_distinct(F.xxhash64("doc_id", "text"))).collect()}  # one row a language
    languages = sorted(n)
    deal = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30))
    share = F.lit(0)
    for name in languages:
        share = F.when(F.col(label) == name, F.lit(min(1.0, per_label / n[name]) * (1 << 30))).otherwise(share)
    sample = (labelled.where(deal < share).select(F.col(label).alias("label"), "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)).alias("fold"), F.xxhash64("doc_id", "text").alias("_row"))
              .groupBy("label", "_row", "fold").agg(F.first("text").alias("text")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, fold in zip(*(batch.column(c).to_pylist() for c in ("label", "text", "fold"))):
                step = max(SEGMENT_CHARS, len(text) // SEGMENTS)
                for i in range(0, min(len(text), step * SEGMENTS), step):
                    code = characters(text[i:i + SEGMENT_CHARS])
                    if code.any():
                        out.append((name, fold, subwords(code).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], ["label", "fold", "rows"])

    # Bounded: languages x PER_LANGUAGE x SEGMENTS pieces of SEGMENT_CHARS characters.
    got = sorted(((r["label"], r["fold"], bytes(r["rows"])) for r in sample.mapInArrow(features, "label string, fold long, rows binary").collect()))
    if not got:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32))
    rows = [np.frombuffer(r[2], dtype=np.int32) for r in got]
    y = np.array([languages.index(r[0]) for r in got])
    seen = np.array([r[1] != 0 for r in got])
    if not seen.any():
        seen[:] = True
    emb, weight, bias = train([r for r, s in zip(rows, seen) if s], y[seen], len(languages))
    model = Model(languages, emb @ weight, bias)
    rest = [r for r, s in zip(rows, seen) if not s]
    calibrate(model, np.array([model.table[r].mean(axis=0) for r in rest]).reshape(-1, len(languages)), y[~seen], target)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the likeliest language, its calibrated probability, and whether that is accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            name, score = [], []
            for text in batch.column("text"):
                got = counts(text.as_py()) if model.languages else None
                if got is None:
                    name.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                p = model.probabilities(got @ model.table / got.sum())
                best = int(p.argmax())
                name.append(model.languages[best])
                score.append(float(p[best]))
            accepted = [n != UNDETERMINED and s >= model.threshold for n, s in zip(name, score)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc32_of_id(), F.lit(4)) == 2
    model = fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
