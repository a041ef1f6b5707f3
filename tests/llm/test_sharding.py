import collections
import random
import zlib

from bazaar.llm import sharding as S


def check(rows, got, shards):
    assert sorted(((r.doc_id or -1, r.size, r.text_crc32) for r in got)) == sorted(((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return {k: sum(r.size for r in v) for k, v in by.items()}


def test_near_equal_and_groups_together(frame):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(0, 400) + str(i)) for i in range(600)] + [(1000 + i, "a copied text " * 20) for i in range(40)] + [(2000, None), (2001, ""), (2001, "")]
    got = S.shard(frame(rows, clash=True), 8).collect()
    sizes = check(rows, got, 8)
    mean = sum(sizes.values()) / 8
    assert max(abs(v - mean) for v in sizes.values()) < 0.02 * mean
    text = dict(rows)
    at = collections.defaultdict(set)
    for x in got:
        at[text[x.doc_id] or ""].add(x.shard)
    assert all(len(v) == 1 for v in at.values())


def test_group_larger_than_a_shard_is_split(frame):
    rows = [(i, "one large group of copies") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(200)]
    sizes = check(rows, S.shard(frame(rows), 4).collect(), 4)
    mean = sum(sizes.values()) / 4
    assert max(abs(v - mean) for v in sizes.values()) < 0.25 * mean


def test_few_rows_and_none(frame):
    assert S.shard(frame([]), 8).count() == 0
    rows = [(1, "a"), (None, None), (None, "b")]
    check(rows, S.shard(frame(rows), 8).collect(), 8)
    assert len({r.shard for r in S.shard(frame([(k, "same") for k in range(3)]), 1).collect()}) == 1


def test_other_dimensions(frame):
    from pyspark.sql import functions as F
    rows = [(i, f"text number {i}") for i in range(300)]
    got = S.shard(frame(rows), 4, {"first": F.length("text").cast("double"), "null": F.lit(None).cast("double")}).collect()
    sizes = check(rows, got, 4)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_no_python_in_the_plan(frame):
    rows = frame([(i, f"text {i % 7}") for i in range(50)])
    plan = S.shard(rows.select("doc_id", "text"), 4)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_cut_is_the_weighted_median(frame):
    from pyspark.sql import functions as F
    r = random.Random(8)
    rows = [(i, f"{i} " + "y" * r.randint(0, 300)) for i in range(500)]
    got = {x.doc_id: x for x in S.shard(frame(rows), 2, {"place": F.pmod(F.col("doc_id") * 37, F.lit(500)).cast("double")}).collect()}
    place = {i: i * 37 % 500 for i, _ in rows}
    halves = [[i for i in got if got[i].shard == k] for k in (0, 1)]
    low, high = sorted(halves, key=lambda half: min(place[i] for i in half))
    assert max(place[i] for i in low) < min(place[i] for i in high)
    # No cut between two rows is nearer to half of all bytes by more than a row.
    left = sum(got[i].size for i in low)
    total, best, run = sum(x.size for x in got.values()), None, 0
    for i in sorted(got, key=place.get):
        run += got[i].size
        best = min(best, abs(run - total / 2)) if best is not None else abs(run - total / 2)
    assert abs(left - total / 2) <= best + max(x.size for x in got.values())
