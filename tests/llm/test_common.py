import random

import numpy as np

from bazaar.llm import common as C


def make(seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "bé", "c", " ", "\n", "\t"]) for _ in range(r.choice([0, 1, 10, 80, 400]))) for _ in range(60)] + ["", None, " ", "x" * 50, "one two three four five"]


def test_fingerprints_follow_content():
    data = np.frombuffer(b"abcabcabcxabc", dtype=np.uint8)
    roll = C.Rolling(data)
    three = roll.all(3)
    assert three[0] == three[3] == three[6] == three[10] and len(set(three.tolist())) == 6
    at = roll.at(np.array([0, 3, 0]), np.array([3, 6, 4]))
    assert at[0] == at[1] != at[2]


def test_words_in_small_pieces_have_the_same_fingerprints():
    for text in make(1):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        start, word = C.word_hashes(data)
        assert len(word) == len((text or "").split())
        for most in (1, 7, 64):
            again = C.word_hashes(data, most)
            assert (again[0] == start).all() and (again[1] == word).all()


def test_shingles_equal_as_the_words_do():
    texts, seen = make(2), {}
    for text in texts:
        words = (text or "").split()
        n = min(5, len(words))
        want = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)] if n else []
        got = C.shingle_hashes(text)
        assert len(got) == len(want)
        for w, h in zip(want, got.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_batches_equal_single_texts():
    texts = make(3)
    cells = [(t or "").encode() for t in texts]
    for words in (1, 3, 5):
        for most in (1, 200, 1 << 20):
            for low, high in C.by_bytes(cells, most):
                got, starts = C.shingle_batch(cells[low:high], words)
                for k in range(high - low):
                    one = C.shingle_hashes(texts[low + k], words)
                    if len((texts[low + k] or "").split()) < words:
                        one = one[:0]
                    assert (got[starts[k]:starts[k + 1]] == one).all() and starts[k + 1] - starts[k] == len(one)
    assert [x for a, b in C.by_bytes(cells, 100) for x in range(a, b)] == list(range(len(cells)))


def test_workers_give_back_what_a_task_has_freed(spark):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            hold = [bytes(60_000) for _ in range(2000)] + [b"x"]   # 120 MB under malloc's mmap threshold
            C.Rolling(np.zeros(1 << 18, dtype=np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(hold)] * len(batch), pa.int64())], ["id", "n"])

    def anonymous():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Pss_Anon"))

    rows = pa.record_batch({"id": [1, 2]})
    before = anonymous()
    assert [b.to_pydict() for b in C.released(run)(iter([rows, rows]))] == [{"id": [1, 2], "n": [2001, 2001]}] * 2
    assert len(C.Rolling._pow) == len(C.Rolling._inv) == C.Rolling.KEPT and anonymous() - before < 30_000
    part = C.released(run)(iter([rows, rows]))
    next(part)
    part.close()   # a reader that wants no more
    assert len(C.Rolling._pow) == C.Rolling.KEPT
    assert (C.Rolling(np.arange(100_000, dtype=np.uint64)).all(9)[:5] == C.Rolling(np.arange(20, dtype=np.uint64)).all(9)[:5]).all()
    assert sorted(map(tuple, spark.range(3).mapInArrow(C.released(run), "id long, n long").collect())) == [(0, 2001), (1, 2001), (2, 2001)]
