import collections
import random
import unicodedata
import zlib

import numpy as np
import pytest
import regex

from bazaar.llm import packing as P


def naive(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(bins) if room >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins), sorted(bins)


@pytest.mark.parametrize("seed", range(60))
def test_histogram_equals_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 16, 50, 64])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 150))]
    steps, n = P.best_fit_decreasing(collections.Counter(lengths), capacity)
    room, seen = [capacity] * n, collections.Counter()
    for length, rank, pieces, first, each, offset in steps:
        assert seen[length] == rank
        seen[length] += pieces
        for i in range(pieces):
            b = first + i // each
            assert capacity - room[b] == offset + i % each * length
            room[b] -= length
    assert seen == collections.Counter(lengths) and (n, sorted(room)) == naive(lengths, capacity)


def test_ids_equal_the_tokenizer(spark):
    e = P.Encoder.of(P.tokenizer_path())
    odd = ["", " ", "don't I'LL x1²³½ \t\n naïve—“q” a<|endoftext|>b", "ΣΑΣ İstanbul 日本語 é \x85\x1c z", "12 34,5.6 €uro ªº ß ẞ", "\u0000 \x7f", "Äpfel,Birnen!!??..."]
    texts = odd + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert e.ids(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_plain_texts_split_as_the_pattern_says():
    e = P.Encoder.of(P.tokenizer_path())
    plain = [c for c in map(chr, range(0x110000)) if not e.odd(c)]
    assert len(plain) == 553 and all(unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) for c in plain)
    r = random.Random(5)
    texts = ["".join(plain), "".join(a + b for a in plain for b in "a1 .'é")] + ["".join(r.choice(plain + list("'strevmld \n") * 40) for _ in range(60)) for _ in range(400)]
    for t in texts:
        assert P.plain_split()(t.lower()) == regex.findall(P.PRETOKEN, t.lower()), t
        assert e.ids(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_remembered_words_are_computed_once():
    calls = []
    known = P.Remembered(lambda w: calls.append(w) or w.encode())
    assert b"".join(map(known.__getitem__, ["a", "b", "a"])) == b"aba" and calls == ["a", "b"]


def test_ids_stay_in_the_tasks_of_packing(frame):
    df = frame([(1, "some words " * 40), (2, None), (3, "x")])
    with_ids, without = (P.pieces(df, P.tokenizer_path(), 32, with_ids=x) for x in (True, False))
    assert without.columns == [c for c in with_ids.columns if c != "ids"]
    assert sorted(without.collect()) == sorted(with_ids.drop("ids").collect())


def test_pieces_round_trip_and_gapless(frame):
    rows = [(i, " ".join(f"word{(i * 7 + k) % 13} the," for k in range(i * 3 % 40))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "x")]
    df, e = frame(rows, clash=True), P.Encoder.of(P.tokenizer_path())
    cut = [r.asDict() for r in P.pieces(df, P.tokenizer_path(), 32).collect()]
    want = collections.Counter((i, np.frombuffer(e.ids(t), dtype="<u4").tobytes() + bytes(4)) for i, t in rows)
    whole, held = collections.Counter(), b""
    for p in cut:  # pieces of a document follow each other
        held = (b"" if p["piece"] == 0 else held) + bytes(p["ids"])
        assert p["length"] * 4 == len(p["ids"]) <= 128 and p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and p["start"] * 4 == len(held) - len(p["ids"])
        if p["length"] < 32 or held in [w[1] for w in want if w[0] == p["doc_id"]]:
            whole[(p["doc_id"], held)] += 1
    assert whole == want
    packed = P.pack_documents(df, capacity=32).collect()
    assert sorted(r.ids_crc32 for r in packed) == sorted(p["ids_crc32"] for p in cut)
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 32
    assert len(by) == naive([r.length for r in packed], 32)[0]


def test_empty_table(frame):
    assert P.pack_documents(frame([])).count() == 0
