import collections
import hashlib
import random
import re

import numpy as np
import pytest

from bazaar.llm import suffix_dedup as S


def brute(rows, size, keep):
    data = [(i, (t or "").encode()) for i, t in rows]
    places = collections.defaultdict(list)
    for row, (i, b) in enumerate(data):
        for p in range(len(b) - size + 1):
            places[b[p:p + size]].append((i, p, row))
    gone = [bytearray(len(b)) for _, b in data]
    for at in places.values():
        if len(at) > 1:
            for i, p, row in sorted(at)[0 if keep == "none" else 1:]:
                gone[row][p:p + size] = b"\1" * size
    return sorted((i, bytes(x for x, g in zip(b, m) if not g)) for (i, b), m in zip(data, gone))


def texts(seed, n=40):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "ab" * 200), (n + 3, "x" * 3000)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("wide", [1, S.WIDE])
def test_matches_brute_force(frame, keep, wide):
    rows = texts(1)
    got = S.remove_repeats(frame(rows, clash=True), 20, keep, anchor_bytes=8, wide=wide).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == brute(rows, 20, keep)
    for r in got:
        b = (r.text or "").encode()
        cut = b"".join(b[x:y] for x, y in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(b)]))
        assert cut == bytes(r.kept) and all(a.end < z.start for a, z in zip(r.spans, r.spans[1:]))


def test_repeated_rows_and_null_ids(frame):
    rows = [(1, "q" * 10 + "abcdefghijklmnopqrstuvwxyz"), (1, "q" * 10 + "abcdefghijklmnopqrstuvwxyz"), (None, "abcdefghijklmnopqrstuvwxyz 1"), (None, None)]
    none = S.remove_repeats(frame(rows), 20, "none", anchor_bytes=8).collect()
    assert sorted(bytes(r.kept) for r in none) == [b"", b"", b"", b" 1"]
    first = S.remove_repeats(frame(rows), 20, "first", anchor_bytes=8).collect()  # null ids come first
    assert sorted(bytes(r.kept) for r in first) == [b"", b"abcdefghijklmnopqrstuvwxyz 1", b"q" * 10, b"q" * 10]


def test_empty_table(frame):
    assert S.remove_repeats(frame([]), 20, anchor_bytes=8).count() == 0


def test_whole_characters():
    t = "aééb"  # bytes: a, c3 a9, c3 a9, b
    assert S.whole_characters(t, [(2, 5)]) == "aéb"
    assert S.whole_characters(t, [(1, 5)]) == "ab"
    assert S.whole_characters(t, [(2, 3)]) == t


def test_cut_repeats_keeps_columns(frame):
    df = frame([(1, "é" * 30 + "."), (2, "-" + "é" * 30)])
    got = {r.doc_id: r for r in S.cut_repeats(df, 20, 8).collect()}
    # judged on the input: a run of one character repeats itself after its first byte pair
    assert list(got[1].asDict()) == df.columns
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[2].text.startswith("-")


def test_smaller_neighbours():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 40)
        v = np.array([r.randint(0, 9) for _ in range(n)])
        run = np.sort([r.randint(0, 3) for _ in range(n)])
        back, on = S.smaller_neighbours(v, run)
        for i in range(n):
            left = [j for j in range(i) if run[j] == run[i] and v[j] < v[i]]
            right = [j for j in range(i + 1, n) if run[j] == run[i] and v[j] < v[i]]
            assert (back[i], on[i]) == (left[-1] if left else -1, right[0] if right else -1)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("wide", [1, S.WIDE])
def test_words_match_brute_force(frame, keep, wide):
    r = random.Random(7)
    parts = [[r.choice(["a", "bé", "c", "dd"]) for _ in range(r.randint(1, 14))] for _ in range(12)]
    rows = [(i, r.choice([" ", "\n", "  "]).join(w for _ in range(r.randint(0, 6)) for w in r.choice(parts))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "x " * 200), (43, " ".join(parts[0] * 3)), (43, " ".join(parts[0] * 3))]
    size, seen, gone = 9, collections.defaultdict(list), {}
    spans = [[m.span() for m in re.finditer(r"[^ \n]+", t or "")] for _, t in rows]
    for row, ((i, t), at) in enumerate(zip(rows, spans)):
        gone[row] = bytearray(len(at))
        for p in range(len(at) - size + 1):
            seen[tuple(t[a:b] for a, b in at[p:p + size])].append((i, p, row))
    for at in seen.values():
        if len(at) > 1:
            first = min((i, p) for i, p, _ in at)  # rows equal in id and text are one place
            for i, p, row in at:
                if keep == "none" or (i, p) != first:
                    gone[row][p:p + size] = b"\1" * size
    want = []
    for row, ((i, t), at) in enumerate(zip(rows, spans)):
        dead = {k for p in range(len(at)) if gone[row][p] for k in range(at[p - 1][1] if p and gone[row][p - 1] else at[p][0], at[p][1])}
        want.append((i, "".join(c for k, c in enumerate(t or "") if k not in dead).encode()))
    got = S.remove_repeats(frame(rows, clash=True), 5000, keep, anchor_bytes=8, wide=wide, min_words=size, anchor_words=4).collect()
    assert sorted((x.doc_id, bytes(x.kept)) for x in got) == sorted(want)


def test_lpf_array_equals_brute_force():
    r = random.Random(5)
    for length in (1, 3, 8, 13, 40):
        for kind in (np.uint8, np.uint64):
            data = np.array([r.choice([1, 2, 200]) for _ in range(300)], dtype=kind)
            start = np.array(sorted(r.sample(range(300 - length + 1), min(150, 300 - length))))
            bucket = np.sort([r.randint(0, 2) for _ in start])
            position = np.array(r.sample(range(1000), len(start)))
            suffixes = S.Suffixes(data, length)
            order = suffixes.order(start, bucket)
            words = [tuple(data[p:p + length].tolist()) for p in start]
            assert [(bucket[i], words[i]) for i in order] == sorted(zip(bucket.tolist(), words))
            got = S.previous_factors(suffixes, order, start, bucket, position)
            match = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), length)
            for i in range(len(start)):
                assert got[i] == max((match(words[i], words[j]) for j in range(len(start)) if bucket[j] == bucket[i] and position[j] < position[i]), default=0)


def test_query_on_driver_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: kept for i, kept in brute(rows, 400, "none")}
    got = S.op1_suffix_dedup(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        whole = len((dict(rows)[r.doc_id] or "").encode())
        assert r.n_bytes == whole and r.n_removed == whole - len(want[r.doc_id]) and r.kept_sha256 == hashlib.sha256(want[r.doc_id]).hexdigest()
        assert (r.n_spans > 0) == (r.n_removed > 0) and r.text == want[r.doc_id].decode("utf-8", "replace")
