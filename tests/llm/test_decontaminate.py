import random

import duckdb
from pyspark.sql import functions as F

from bazaar.llm import decontaminate as D


def shingles(words, n):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def brute(docs, items):
    out = []
    for d, t in docs:
        for i, q in items:
            q = (q or "").split()
            n = min(5, len(q))
            if n:
                s = shingles(q, n)
                found = len(s & shingles((t or "").split(), n))
                if found >= 0.8 * len(s):
                    out.append((d if d is not None else -1, i if i is not None else -1, len(s), found))
    return sorted(out)


def make(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 5, 9, 20, 57, 130])))) for i in range(30)] + [(50, None), (51, " "), (None, "null id item here")]
    docs = []
    for k in range(60):
        words = [word() for _ in range(r.choice([0, 4, 40, 600, 4000]))]
        if k % 2:
            q = (r.choice(items)[1] or "").split()
            if q and r.random() < 0.4:
                q[r.randrange(len(q))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = q
        docs.append((k, " ".join(words)))
    return docs + [(100, None), (101, ""), (101, ""), (None, items[4][1])], items


def test_matches_brute_force(spark, frame):
    docs, items = make(3)
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    for block in (D.BLOCK_BYTES, 500):  # many blocks of items
        got = D.find_items(frame(docs, clash=True), table, block_bytes=block).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id if r.item_id is not None else -1, r.n_shingles, r.n_found) for r in got) == brute(docs, items)
    clean = D.without_items(frame(docs, clash=True), table, block_bytes=500)
    hit = {d for d, *_ in brute(docs, items)}
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in clean.collect()) == sorted(d if d is not None else -1 for d, _ in docs if (d if d is not None else -1) not in hit)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(frame([(1, "a b c")]), none).count() == 0
    assert D.without_items(frame([(1, "a b c")]), none).count() == 1
    assert D.find_items(frame([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(D.ORACLE)
    names = [d[0] for d in cur.description]
    got = D.op9_decontamination(spark, sf)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
