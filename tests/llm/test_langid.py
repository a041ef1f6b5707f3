import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from bazaar.llm import langid as L

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in L.op3_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= got[d.doc_id].score <= 1
    held = [d for d in docs if got[d.doc_id].held_out]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.95


def test_defined_results(frame):
    model = L.Model(["a", "b"], np.zeros((1 << L.BUCKET_BITS, 2), np.float32), np.zeros(2, np.float32))
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "é"), (4, "é"), (None, "x" * 300_000)]
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in L.predict(frame(rows, clash=True), model).collect())
    assert got == [(0, "a", 0.5), (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "a", 0.5), (4, "a", 0.5)]
    unlabelled = L.fit(frame([(1, "x")]).withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.languages == [] and L.predict(frame([(1, "x")]), unlabelled).first().lang_pred == "und"
    assert L.predict(frame([]), model).count() == 0


def test_long_texts_count_every_character():
    text = "abc déf " * 50_000
    whole = L.subwords(L.characters(text))
    assert L.counts(text).sum() >= len(whole) and (L.counts(text) >= np.bincount(whole, minlength=1 << L.BUCKET_BITS)).all()


def test_calibration_rejects():
    model = L.Model(["a", "b"], np.zeros((4, 2)), np.zeros(2))
    logits = np.array([[3.0, 0], [0, 3], [0.2, 0], [0, 0.2]] * 20)
    label = np.array([0, 1, 1, 0] * 20)  # the unsure ones are wrong
    L.calibrate(model, logits, label, 0.99)
    p = model.probabilities(logits).max(axis=1)
    assert ((p >= model.threshold) == np.array([True, True, False, False] * 20)).all()


def by_hand(model, text):
    """Mean of the rows' logits over all n-grams of the text, then the softmax."""
    rows = L.subwords(L.characters(text))
    z = (model.table[rows].astype(float).mean(axis=0) + model.bias) / model.temperature
    p = [math.exp(x - max(z)) for x in z]
    best = max(range(len(p)), key=lambda k: (p[k], -k))
    return model.languages[best], p[best] / sum(p)


def test_prediction_equals_forward_pass_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where("doc_id % 3 <> 0"))
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and len(r.text) < 20_000}
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    for i, text in texts.items():
        if L.characters(text).any():
            name, score = by_hand(model, text)
            assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-5


def test_repeated_rows_count_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    hot = docs.where("doc_id = 1").crossJoin(spark.range(100_000)).drop("id")
    once, often = L.fit(docs, per_label=40), L.fit(docs.unionByName(hot), per_label=40)
    assert once.languages == often.languages and np.allclose(once.table, often.table)
