import random

from bazaar.llm import token_counts as C


def greedy(word, pieces):
    n = i = 0
    longest = max(map(len, pieces))
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces:
                break
        else:
            return 0
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy():
    for seed in range(300):
        r = random.Random(seed)
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        m = C.LongestMatch(pieces)
        for _ in range(20):
            w = "".join(r.choice("abc") for _ in range(r.randint(0, 15)))
            assert m.count(w) == greedy(w, pieces)


def test_texts_equal_greedy(spark, frame):
    pieces = set(C.vocabulary(C.vocabulary_path()))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "日本語 a日 the"), (9004, "ab" * 5000), (9004, "ab" * 5000), (None, "the ▁ x▁y")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_tokens, r.n_unknown) for r in C.token_counts(frame(rows, clash=True)).collect())
    want = []
    for i, t in rows:
        counts = [greedy("▁" + w, pieces) for w in (t or "").split()]
        want.append((i or -1, len(counts), sum(counts) + counts.count(0), counts.count(0)))
    assert got == sorted(want)


def test_empty_table(frame):
    assert C.token_counts(frame([])).count() == 0
