"""Conversation repair against a direct programme over rows, on small and skewed conversations."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from bazaar.llm import repair as R
SF = "/root/testdata/sf0.001"

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"


def broken(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def brute(rows):
    """All cheapest edits by a programme over (row, role emitted last) that compares whole audits."""
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], [])
    for row in broken(rows):
        by_conv[row[0]].append(row)
    out = []
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64]))
        seen, fault = set(), []
        for _, _, role, text in mine:
            last = text.rstrip(WHITE)[-1:]
            fault.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        after = {"": "u", "s": "u", "u": "a", "a": "u"}

        @lru_cache(maxsize=None)
        def best(i, state, inserts=0):
            found = []
            if i == len(mine):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                found.append((2, "D", best(i + 1, state)))
                if fault[i] not in ("blank", "duplicate"):
                    extra = 5 * (fault[i] == "truncated")
                    if initials[i] == after[state] or (state == "" and initials[i] == "s"):
                        found.append((extra, "K", best(i + 1, initials[i]), mine[i][2] + ":" + mine[i][3]))
                    to = after[state]
                    found.append((1 + extra, "R", best(i + 1, to), {"u": "user", "a": "assistant"}[to] + ":" + mine[i][3]))
            if inserts < 3:
                to = after[state]
                found.append((5, "I", best(i, to, inserts + 1), {"u": "user:", "a": "assistant:"}[to]))
            done = []
            for x in found:
                if len(x) == 3 and x[1] == "":
                    done.append(x)
                elif x[2] is not None:
                    done.append((x[0] + x[2][0], x[1] + x[2][1], x[3:] + x[2][2]))
            return min(done, default=None)

        cost, audit, lines = best(0, "")
        out.append((conv, gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
                    sum((a + b) not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, kinds="conv_id long, turn long, role string, text string"):
    done = R.repair(R.damaged(spark.createDataFrame(rows, kinds)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in done.collect()), key=repr)


def some_rows(rng, convs=60):
    words = ["Yes.", "No", "", " \n", "Why?", "go on", "É fin!", "end. \t", None]
    out = []
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randint(1, 9)):
            turn += rng.choice([0, 1, 1, 1, 3])
            out.append((conv, None if rng.random() < 0.08 else turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice(words)))
    return out


def test_against_brute_force(spark):
    rows = some_rows(random.Random(5))
    expected = [r for r in brute(rows) if r[7] != "" or broken([x for x in rows if x[0] == r[0]])]
    assert run(spark, rows) == expected


def test_hot_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    hot = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"Turn {t}.", "Same.", "cut off", f"late {t}"])) for t in range(400)]
    rows = hot + [(c + 100, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(20) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        damaged = R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert R.marked(damaged).where("conv_id = 7").select("part").distinct().count() > 2
        got = run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [r for r in brute(rows) if broken([x for x in rows if x[0] == r[0]])]


def test_runs_by_powers_equal_row_by_row():
    rng = random.Random(1)
    for _ in range(200):
        ahead = R.FINISH
        symbol, n = rng.randrange(9), rng.randint(1, 40)
        for _ in range(n):
            ahead = R.before(R.power(symbol, 0), ahead)
        assert R.before_run(symbol, n, R.FINISH) == ahead
        assert R.before(R.run_matrix([(symbol, n)]), R.FINISH) == ahead


def test_repeated_rows_long_texts_and_other_ids(spark):
    rows = [("a", 1, "user", "Hi. " * 200_000)] * 3 + [("a", 2, "assistant", "x")] * 50 + [(None, None, None, None), ("b", 3, "system", "S.")]
    assert run(spark, rows, "conv_id string, turn int, role string, text string") == [r for r in brute(rows) if broken([x for x in rows if x[0] == r[0]])]


def test_query_covers_all_ids_and_empty_tables(spark, tmp_path):
    rows = some_rows(random.Random(2), 40) + [(900, 1, "user", "Only.")]
    extra = [(*r, 1) for r in rows]
    spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, part int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in R.op12_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    none.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert R.op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_driver_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in R.op12_conversation_repair(spark, sf).collect()), key=repr)
    assert got == brute(rows)
