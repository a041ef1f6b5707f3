"""Each stage against a brute-force version on its own input, and the whole run."""

import collections
import random
import re

import corpus_pipeline as C
from bazaar.llm import quality, suffix_dedup
from bazaar.llm.common import cut, table

from .test_decontaminate import brute as leaks
from .test_near_join import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns, stage = docs.columns, dict(C.STAGES)
    assert list(stage) == ["quality_classifier", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    good = cut(stage["quality_classifier"](spark, docs, SF))
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, table(spark, SF, "labels").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"))).collect()}
    assert sorted(rows(good)) == sorted(r for r in rows(docs) if scores[r[0]] >= quality.THRESHOLD)

    one = cut(stage["near_duplicates"](spark, good, SF))
    assert sorted(r[0] for r in rows(one)) == sorted({c for _, c, _, _ in classes(rows(good))})

    less = cut(stage["suffix_dedup"](spark, one, SF))
    assert dict(rows(less)) == passages_cut(rows(one)) and all(r.n_chars == len(r.text) for r in less.collect())

    clean = cut(stage["decontamination"](spark, less, SF))
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaked = {d for d, *_ in leaks(rows(less), items)}
    assert sorted(rows(clean)) == sorted(r for r in rows(less) if r[0] not in leaked)
    assert good.columns == one.columns == less.columns == clean.columns == columns

    packed = stage["packing"](spark, clean, SF).collect()
    tokens = collections.Counter()
    for r in packed:
        tokens[r.sequence_id] += r.length
    assert {r.doc_id for r in packed} == {i for i, _ in rows(clean)} and max(tokens.values()) <= 2048
    run = C.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, packed))


def test_empty_table(spark, frame):
    docs = frame([])
    for _, stage in C.STAGES:
        docs = cut(stage(spark, docs, SF))
        assert docs.count() == 0


def test_clashing_columns_and_a_very_long_text(spark, frame):
    r = random.Random(12)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60_000)) + "."
    rows = [(1, long), (2, long), (3, "Some words that stand alone."), (4, long + " And one more.")]
    docs = frame(rows, clash=True)
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        assert docs.columns == columns and all(x.spans == str(x.doc_id) for x in docs.collect())
        if name == "near_duplicates":
            assert {x.doc_id for x in docs.collect()} <= {1, 3}
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert {x.doc_id for x in packed.collect()} == {x.doc_id for x in docs.collect()}


def test_nulls_and_repeats_pass_all_stages(spark, frame):
    docs = frame([(1, None), (2, ""), (3, "A plain sentence of words."), (3, "A plain sentence of words."), (None, "Another one, without an id.")])
    for _, stage in C.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() >= 1


def passages_cut(rows):
    """Texts without later copies of strings of 51 words (white space aside) or of ``PASSAGE_BYTES`` bytes."""
    seen_words, seen_bytes, out = set(), set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        word = [m.span() for m in re.finditer(rb"[^ \t\n\r\f\x0b]+", b)]
        gone, drop = bytearray(len(b)), bytearray(len(word))
        for p in range(len(word) - 50):
            w = tuple(b[x:y] for x, y in word[p:p + 51])
            if w in seen_words:
                drop[p:p + 51] = b"\1" * 51
            seen_words.add(w)
        for p, (x, y) in enumerate(word):
            if drop[p]:
                gone[word[p - 1][1] if p and drop[p - 1] else x:y] = b"\1" * (y - (word[p - 1][1] if p and drop[p - 1] else x))
        for p in range(len(b) - C.PASSAGE_BYTES + 1):
            w = b[p:p + C.PASSAGE_BYTES]
            if w in seen_bytes:
                gone[p:p + C.PASSAGE_BYTES] = b"\1" * C.PASSAGE_BYTES
            seen_bytes.add(w)
        edge = [p for p in range(len(b) + 1) if (gone[p] if p < len(b) else 0) != (gone[p - 1] if p else 0)]
        out[i] = suffix_dedup.whole_characters(t, list(zip(edge[::2], edge[1::2])))
    return out


def test_passages_of_short_words_are_cut(spark, frame):
    r = random.Random(5)
    words = lambda n, most=3: [r.choice("abcdefghé") * r.randint(1, most) + r.choice("klmnop") for _ in range(n)]
    passages = [words(60), words(51), words(50), words(51, 9), [w * 3 for w in words(45, 9)], words(130)]
    rows = []
    for i in range(40):
        text = words(r.randint(0, 30))
        for p in r.sample(passages, r.randint(0, 3)):
            text += p + words(r.randint(0, 20))
        rows.append((i, r.choice([" ", "\n ", "  "]).join(text)))
    rows += [(50, " ".join(passages[0])), (51, "\t".join(passages[0])), (52, "a " * 300), (53, "語" * 150), (54, "-" + "語" * 150)]
    got = {x.doc_id: x.text for x in dict(C.STAGES)["suffix_dedup"](spark, frame(rows), SF).collect()}
    assert got == passages_cut(rows)
    assert got[50] == got[51] == "" and all(len(" ".join(passages[k])) < 300 for k in (0, 1, 2))
