"""Ranked search against scoring every document, term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bazaar.llm import lexical as L

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = [c for _, c in counted if c]
    n, size = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // max(1, size)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    got = L.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_text(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "GAMMA", "ñandú", "É", "x1", "the", "of"] + [f"w{int(rng.expovariate(0.05))}" for _ in range(8)]) for _ in range(n))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(L, "DOCS", 16)
    docs = [(i, some_text(rng, rng.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [docs[7]] * 3 + [(None, docs[9][1]), (2000, None), (2001, "... !!"), (2002, "the " * 3000)]
    items = [(i, some_text(rng, rng.randint(1, 25))) for i in range(12)] + [(50, docs[5][1]), (50, docs[5][1]), (51, None), (52, "zzz unknown"), (53, "")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, block_bytes=200) == brute(docs, items)
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_pair_bounds_skip_more_than_term_maxima():
    rng = random.Random(9)
    rare = [f"r{i}" for i in range(40)]
    texts = [f"{rng.choice(rare)} " + "pad " * rng.randint(1, 5) for _ in range(400)] + [" ".join(rare[:8])] * 12
    items = [" ".join(rare[:8])]
    vocabulary = np.unique(np.concatenate([L.item_terms(t) for t in items]))
    length, term, doc, tf = L.postings([t.encode() for t in texts], vocabulary)
    df = dict(zip(*(x.tolist() for x in np.unique(term, return_counts=True))))
    queries = L.Queries([np.searchsorted(vocabulary, L.item_terms(items[0]))], len(texts), int(length.sum()), df, len(vocabulary))
    row = {"lengths": length.astype(np.int64).tobytes(), "term": term.astype(np.int32).tobytes(), "doc": doc.astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes()}
    block = L.Block(row, queries)
    docs, score = block.search(queries.items[0], 1)
    least = int(np.sort(score)[-10])
    # One rare term with its list's maximum cannot reach the tenth score, so only the documents with whole pairs are looked at.
    assert (block.joint <= [sum(int(block.postings(t)[1].max()) for t in p) for p in queries.pairs]).all()
    assert set(block.candidates(queries.items[0], least)) == set(range(400, 412))
    assert sorted(block.search(queries.items[0], least)[1]) == sorted(s for s in score if s >= least)
    independent = sum(max(int(block.postings(t)[1].max()) for t in p) for p in queries.pairs)
    assert independent < least


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = some_text(rng, 3000) + " " + "q" * 500
    whole = Counter(terms(text))
    monkeypatch.setattr(L, "PIECE", 64)
    vocabulary = L.item_terms(text)
    length, term, doc, tf = L.postings([b"", text.encode(), b"alpha"], vocabulary)
    assert length.tolist() == [0, sum(whole.values()), 1] and len(vocabulary) == len(whole)
    assert sorted(tf[doc == 1].tolist()) == sorted(whole.values()) and (np.diff(term * 3 + doc) > 0).all()


def test_other_ids_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two", 1, 5), ("a", "one two", 2, 6), (None, "one two", 3, 7), ("c", "other", 4, 8)], "doc_id string, text string, rank int, score int")
    items = spark.createDataFrame([("x", "One, two!", 1)], "item_id string, text string, item int")
    got = [(r.item_id, r["rank"], r.doc_id) for r in L.rank_documents(docs, items).orderBy("rank").collect()]
    assert got == [("x", 1, "a"), ("x", 2, "b"), ("x", 3, None)]
    assert L.rank_documents(docs.limit(0), items).count() == 0 and L.rank_documents(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_driver_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in L.op11_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute(docs, items)
