import itertools
import zlib

import numpy as np

from bazaar.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    length = np.array([1, 4, 2, 5])
    score, link = rng.normal(size=length.sum()), rng.normal(size=(2, 2))
    good, pairs = Q.forward_backward(score, length, link)
    want, count, at = [], np.zeros((2, 2)), 0
    for n in length:
        s = score[at:at + n]
        at += n
        weight = {y: np.exp(sum(s[t] for t in range(n) if y[t]) + sum(link[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weight.values())
        want += [sum(w for y, w in weight.items() if y[t]) / z for t in range(n)]
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                count[a, b] += w / z
    assert np.allclose(good, want) and np.allclose(pairs, count)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.op7_line_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [x for x in labels if got[x.doc_id].held_out]
    assert np.mean([got[x.doc_id].predicted == x.quality for x in held]) > 0.95
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_lines_and_long_lines():
    bins, size = Q.line_features("a b\n\n" + "x" * (2 * Q.LINE_BYTES + 5))
    assert len(bins) == 5 and size.tolist() == [3, 1, Q.LINE_BYTES, Q.LINE_BYTES, 5]
    assert len(Q.line_features(None)[0]) == len(Q.line_features("")[0]) == 1
    many = "\n".join(f"line {i} of many" for i in range(5000))
    assert len(Q.line_features(many)[0]) == 5000


def test_defined_results(frame):
    rows = [(1, None), (2, ""), (3, "é\n\n\x00 !"), (3, "é\n\n\x00 !"), (None, "word " * 30_000)]
    df = frame(rows, clash=True)
    got = Q.score(df, Q.Chain()).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(df, None).first().score == 0.5
    kept = Q.score(df, Q.Chain(), extra=True)
    assert kept.columns == [*[c for c in df.columns if c != "score"], "score"] and kept.count() == 5
    assert Q.score(frame([]), Q.Chain()).count() == 0
    none = df.select("doc_id").withColumn("quality", df["doc_id"].cast("int")).where("doc_id < 0")
    assert Q.fit(df, none) is None


def test_repeated_labels_and_documents_count_once(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    first = labels.first().doc_id
    hot = spark.range(100_000).drop("id")
    often = Q.fit(docs.unionByName(docs.where(f"doc_id = {first}").crossJoin(hot)), labels.unionByName(labels.where(f"doc_id = {first}").crossJoin(hot)))
    once = Q.fit(docs, labels)
    assert np.allclose(once.slope, often.slope) and np.allclose(once.shift, often.shift)
