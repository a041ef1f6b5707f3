import collections
import itertools
import random

import duckdb
import numpy as np
import pytest

from bazaar.llm import near_join as J


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    sets, up, links = {t: shingles(t) for t in by}, {t: t for t in by}, collections.Counter()

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in itertools.combinations(by, 2):
        n = len(sets[a] & sets[b])
        if n and n >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            up[top(a)] = top(b)
    least = collections.defaultdict(list)
    for t, ids in by.items():
        least[top(t)] += [i for i in ids if i is not None]
    return sorted((i if i is not None else -1, min(least[top(t)], default=None), links[t], len(ids)) for t, ids in by.items() for i in ids)


def near_texts(seed):
    r = random.Random(seed)
    rows, n = [], 0
    for group in range(12):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(40, 300))]
        for _ in range(r.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 9999)}"
            rows.append((n, " ".join(words)))
            n += 1
    shared = " ".join(f"common{i}" for i in range(20))  # a passage of many unlike texts
    rows += [(n + i, shared + " " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(150))) for i in range(30)]
    return rows


@pytest.mark.parametrize("tile", [1000, 4])
def test_matches_brute_force(frame, tile):
    rows = near_texts(1) + [(9000, None), (9001, ""), (9002, " "), (9003, "a b"), (9004, "a  b"), (9005, "z " * 9000), (9005, "z " * 9000), (None, "only here")]
    got = J.near_classes(frame(rows, clash=True), tile=tile).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links, r.n_copies) for r in got) == brute(rows)


@pytest.mark.parametrize("chunk", [400, 3])
def test_one_of_each(frame, chunk):
    rows = near_texts(2) + [(9005, "again"), (9005, "again"), (9006, "again")]
    df = frame(rows, clash=True)
    kept = J.one_of_each(df, chunk=chunk)
    assert kept.columns == df.columns
    heads = {c for _, c, _, _ in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads)


def test_empty_table(frame):
    assert J.near_classes(frame([])).count() == 0 and J.one_of_each(frame([])).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 102), (7, 7)]
    got = dict(J.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, 105: 100, 102: 100}


def test_similar():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(20)]
    pair = rng.random((20, 20)) < 0.7
    pair = np.triu(pair, 1) | np.triu(pair, 1).T
    got = J.similar(sets, pair, 0.3)
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.3 * len(np.union1d(a, b)) - 1e-9
    assert all(got[i, j] == (pair[i, j] and near(sets[i], sets[j])) for i in range(20) for j in range(20))


def test_oracle_on_small_table(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(J.ORACLE)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = J.op8_near_join(spark, sf)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("tile", [1000, 2])
def test_repeated_and_null_id_rows_with_near_copies(frame, tile):
    r = random.Random(4)
    base = lambda: [f"w{r.randint(0, 5000)}" for _ in range(120)]
    near = lambda words, k: " ".join(f"x{k}" if p == 7 * k else w for p, w in enumerate(words))
    a, b, c = base(), base(), base()
    rows = [(1, " ".join(a)), (1, " ".join(a)), (2, near(a, 1)), (2, near(a, 2)), (2, near(a, 2)), (None, near(a, 3)), (None, near(a, 3))]
    rows += [(None, " ".join(b))] * 3 + [(None, near(b, 1)), (7, near(b, 2))]
    rows += [(None, " ".join(c)), (None, " ".join(c)), (None, near(c, 1))]
    got = J.near_classes(frame(rows), tile=tile).collect()
    key = lambda x: tuple(-2 if v is None else v for v in x)
    assert sorted(key((x.doc_id if x.doc_id is not None else -1, x.class_id, x.n_links, x.n_copies)) for x in got) == sorted(map(key, brute_rows(rows)))


def brute_rows(rows):
    """``brute`` with classes of null ids among others."""
    by = {t: [i for i, u in rows if u == t] for _, t in rows}
    link = lambda x, y: len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y)) - 1e-9
    out = []
    for t, ids in by.items():
        reached, todo = {t}, [t]
        while todo:
            x = todo.pop()
            more = [y for y in by if y not in reached and link(x, y)]
            reached.update(more)
            todo += more
        least = min((i for y in reached for i in by[y] if i is not None), default=None)
        out += [(i if i is not None else -1, least, sum(link(t, y) for y in by if y != t), len(ids)) for i in ids]
    return out


def test_one_of_each_class_whatever_the_ids(frame):
    r = random.Random(6)
    base = lambda: [f"w{r.randint(0, 5000)}" for _ in range(120)]
    near = lambda words, k: " ".join(f"x{k}" if p == 7 * k else w for p, w in enumerate(words))
    a, b, c, d = base(), base(), base(), base()
    classes = [[(5, near(a, 1)), (5, near(a, 2)), (None, near(a, 3))], [(3, near(b, 1)), (5, near(b, 2)), (5, near(b, 2))],
               [(None, near(c, 1)), (None, near(c, 1)), (None, near(c, 2))], [(None, near(d, 1)), (8, near(d, 2)), (8, near(d, 2))], [(None, "alone")]]
    df = frame([x for rows in classes for x in rows])
    kept = [(x.doc_id, x.text) for x in J.one_of_each(df).collect()]
    assert len(kept) == len(classes)
    for rows in classes:
        (head,) = [x for x in kept if x in rows]
        assert head[0] == min((i for i, _ in rows if i is not None), default=None)


@pytest.mark.parametrize("chunk", [400, 5])
def test_roots_of_large_groups_and_chains(frame, chunk):
    r = random.Random(11)
    base = [f"w{r.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for k in range(60):  # all near one another, in a hot node of each tree
        words = list(base)
        words[r.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    chain = [f"c{i}" for i in range(150)]
    for k in range(25):  # neighbours are near, ends are not
        rows.append((100 + k, " ".join(chain)))
        chain[5 * k + 60 if 5 * k < 80 else 5 * k - 80] = f"y{k}"
        chain[(5 * k + 61) % 150] = f"z{k}"
    rows += [(200 + k, " ".join(base[:75] + [f"u{k}_{i}" for i in range(75)])) for k in range(10)]
    texts = {r.text_id: r.root for r in J.text_roots(frame(rows), chunk=chunk).collect()}
    want = brute(rows)
    assert len(texts) == len({t for _, t in rows}) and len(set(texts.values())) == len({c for _, c, _, _ in want})
    kept = sorted(r.doc_id for r in J.one_of_each(frame(rows), chunk=chunk).collect())
    assert kept == sorted({c for _, c, _, _ in want})
