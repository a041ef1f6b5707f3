"""Mixing: targets against plain water-filling, exact quotas, disjoint draws, skew and reruns."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from bazaar.llm import mixing as M

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, source string"


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the contract's words, source by source."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, list(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > most * sizes[s]]
        if not above:
            return out | {s: weight[s] * level for s in free}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(spark, rows, **options):
    docs = spark.createDataFrame(rows, KINDS)
    mixed = M.mix(docs, **options)
    got = mixed.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r["size"]) for r in got) == sorted((i is None, i or 0, s or "", words(t)) for i, t, s in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.draws)
        assert len(r.draws) <= 2 and len({d["pass"] for d in r.draws}) == len(r.draws) and (r["size"] or not r.draws)
    goal = filled(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
    longest = max((r["size"] for r in got), default=0)
    for s in sizes:
        assert abs(goal[s] - taken[s]) <= max(longest / 2, 1), (s, taken[s], goal[s])
    return got


def test_water_filling(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 1}, {"a": 0, "b": 0}, {f"s{i:03}": i * i % 97 for i in range(50)}):
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in M.targets(frame).collect()}
        goal = filled(sizes)
        assert got.keys() == goal.keys() and all(abs(got[s] - goal[s]) < 1e-9 * max(1, goal[s]) for s in goal)


def test_split_tree_is_exact_and_unbiased():
    quotas, room = np.array([5, 0, 100, 33]), M.equal_room(138, 7)
    total = np.zeros((4, 7))
    for seed in range(300):
        out = M.split_tree(quotas, room, [seed])
        assert (out.sum(axis=1) == quotas).all() and (out.sum(axis=0) == room).all() and (out >= 0).all()
        total += out
    assert np.abs(total / 300 - quotas[:, None] * room[None, :] / 138).max() < 0.5
    assert (M.split_tree(quotas, room, [1]) == M.split_tree(quotas, room, [1])).all()


def test_nearest_fit_equals_trying_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        sizes = rng.integers(1, 60, rng.integers(1, 10)).tolist()
        rest = float(rng.integers(0, 2 * sum(sizes))) / 2
        got = sum(x for x, f in zip(sizes, M.nearest_fit(sizes, rest)) if f)
        sums = {sum(x for k, x in enumerate(sizes) if mask >> k & 1) for mask in range(1 << len(sizes))}
        assert abs(got - rest) == min(abs(x - rest) for x in sums)
    many = rng.integers(1, 500, 3000).tolist()
    taken = M.nearest_fit(many, 12_345.25)
    assert sum(x for x, f in zip(many, taken) if f) == 12_345
    assert M.nearest_fit([10**9, 4 * 10**8], 5e8) == [False, True]


def test_hot_source_repeats_nulls_and_long_texts(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 40)), f"s{i % 9}" if i % 3 else "hot") for i in range(900)]
    rows += [(5000, "same words here", "s1")] * 1500 + [(6000, "long " * 30_000, "s2"), (6001, None, "s3"), (6002, "", None), (None, "no id", None), (None, None, None)]
    got = checked(spark, rows, block_words=300, shards=5)
    # Draws of the whole output: shards differ by one block at most, and a block is in a shard once per pass.
    draws = {(r.source, d["pass"], d["draw_order"], d["shard"]) for r in got for d in r.draws}
    where = defaultdict(set)
    for source, which, order, shard in draws:
        where[source, which, order].add(shard)
    assert all(len(s) == 1 for s in where.values())
    again = M.mix(spark.createDataFrame(rows, KINDS).repartition(7), block_words=300, shards=5).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_shards_hold_equal_numbers_of_draws(spark):
    quotas = spark.createDataFrame([(1, 10, 1, 3, 2.0, 14, 0), (2, 7, 2, 0, 0.0, 14, 0), (3, 1, 0, 0, 1.0, 1, 1)], "place long, blocks long, passes long, whole long, part_rest double, quota long, group int")
    got = M.draws(quotas, 4, 9).collect()
    assert len(got) == len({(r.place, r.block, r["pass"]) for r in got}) == 29
    assert sorted(np.bincount([r.shard for r in got]).tolist()) == [7, 7, 7, 8]
    assert {r.block for r in got if r.place == 1 and r["pass"] == 1} == {0, 1, 2, 3}


def test_shuffled_rows_carry_their_texts(spark):
    rows = [(i, f"text {i} of some words", f"s{i % 4}") for i in range(60)] + [(7, "another of the same id", "s3")]
    docs = spark.createDataFrame(rows, KINDS)
    mixed = M.mix(docs, shards=3, block_words=20)
    out = M.shuffled(mixed, docs).collect()
    times = mixed.select("doc_id", F.size("draws").alias("n")).groupBy("doc_id").sum("n").collect()
    assert len(out) == sum(r[1] for r in times) and all((r.doc_id, r.text, r.source) in rows for r in out)


def test_empty_table_clashing_columns_and_driver_table(spark, frame):
    assert M.mix(spark.createDataFrame([], KINDS)).count() == 0
    clash = frame([(1, "a b"), (2, None)], clash=True)
    assert sorted((r.doc_id, r["size"], len(r.draws)) for r in M.mix(clash).collect()) in ([(1, 2, 1), (2, 0, 0)], [(1, 2, 2), (2, 0, 0)])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = checked(spark, rows)
    taken = {r.doc_id: r["size"] * len(r.draws) for r in got}
    assert {r.doc_id: r.taken for r in M.op13_source_mixing(spark, SF).collect()} == taken
