"""Byte-balanced shards by k-d tree partitioning, in DataFrame functions only.

Rows with equal texts form a group that stays together.  Groups are points in a
space of metadata (by default text size, least id, source and language).  The
tree starts with all shards as one node; a node of several shards is split along
the dimension in which its points spread widest, at the weighted median (or the
fraction that fits its shards' room), until a node is one shard and holds its
target bytes.  Medians are found on distributed histograms: each round sums bytes
in ``CELLS`` cells per open node and narrows each node to the cell that holds its
median.  Only these sums come to the driver, at most shards x CELLS rows a round.
Ties are split by a hash of the text, so a value that many groups share does not
unbalance a split.

Groups of more than 1 / ``HEAVY`` of a shard's target, of which there are at most
HEAVY x shards, would make any median coarse.  They are placed first, largest
first into the emptiest shard, and the tree fills the room they leave.  A group
larger than a whole shard's target is the one kind that is split (by stored row),
into parts that are placed the same way.

Defined results: a null text counts as empty (size 1, crc32 0, one group with
empty texts); a null metadata value is the least; rows equal in all columns are
sharded each; with fewer groups than shards some shards stay empty; extra columns
are passed over; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.llm.common import cut, table

CELLS, HEAVY = 2048, 64
#: Bits of a coordinate for the metadata value, and below them for the hash that splits ties.
VALUE_BITS, TIE_BITS = 20, 40
#: A median is settled once its cell holds less than this share of a shard.
TOLERANCE = 0.0005


def default_dimensions(docs: DataFrame) -> dict[str, Column]:
    """Numbers that describe a row; those whose column is missing are left out."""
    dims = {"size": F.log2(F.col("size").cast("double"))}
    if dict(docs.dtypes).get("doc_id") in ("tinyint", "smallint", "int", "bigint"):
        dims["id"] = F.col("doc_id").cast("double")
    for name in ("source", "lang"):
        if name in docs.columns:
            dims[name] = F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")).cast("double")
    return dims


class Node:
    """Shards that are still together: their ids, and how points come here."""

    def __init__(self, shards: list[int], room: list[float]):
        self.shards, self.room = shards, room
        self.dim: str | None = None
        self.low = self.high = self.below = self.at = 0
        self.left: Node | None = None
        self.right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def walk(self, of) -> Column:
        """A value by leaf, as a nested condition on the coordinates."""
        if self.left is None:
            return of(self)
        return F.when(F.col(self.dim) < F.lit(self.at), self.left.walk(of)).otherwise(self.right.walk(of))


def _split_all(points: DataFrame, root: Node, dims: list[str], target: float) -> None:
    """Splits every leaf of several shards once: widest dimension, weighted median by shrinking histograms."""
    nodes = [n for n in root.leaves() if len(n.shards) > 1]
    by_name = {i: n for i, n in enumerate(nodes)}
    mine = root.walk(lambda n: F.lit(next((i for i, m in by_name.items() if m is n), -1)))
    placed = points.withColumn("_node", mine).where("_node >= 0")
    spread = placed.groupBy("_node").agg(*(f(d).alias(f"{d}_{s}") for d in dims for s, f in (("low", F.min), ("high", F.max))), F.sum("w").alias("w"))
    seen = {r["_node"]: r for r in spread.collect()}  # a row for each open node
    active: dict[int, float] = {}
    for i, n in by_name.items():
        half = len(n.shards) // 2
        n.left, n.right = Node(n.shards[:half], n.room[:half]), Node(n.shards[half:], n.room[half:])
        if i not in seen:
            n.dim, n.at = dims[0], 0
            continue
        r = seen[i]
        n.dim = max(dims, key=lambda d: r[f"{d}_high"] - r[f"{d}_low"])
        n.low, n.high, n.below = r[f"{n.dim}_low"], r[f"{n.dim}_high"] + 1, 0
        active[i] = float(r["w"]) * sum(n.left.room) / max(sum(n.room), 1e-9)
    while active:
        where = lambda f: F.coalesce(*(F.when(F.col("_node") == i, f(by_name[i])) for i in active))
        step = {i: max(1, -(-(by_name[i].high - by_name[i].low) // CELLS)) for i in active}
        at = where(lambda n: F.col(n.dim))
        low, high = where(lambda n: F.lit(n.low)), where(lambda n: F.lit(n.high))
        width = F.coalesce(*(F.when(F.col("_node") == i, F.lit(step[i])) for i in active))
        cells = (placed.where(F.col("_node").isin(list(active))).select("_node", "w", at.alias("at"), low.alias("low"), high.alias("high"), width.alias("width"))
                 .where("at >= low AND at < high").groupBy("_node", F.expr("(at - low) div width").alias("cell")).agg(F.sum("w").alias("w")).collect())
        for i, goal in list(active.items()):
            n, run = by_name[i], by_name[i].below
            for r in sorted((r for r in cells if r["_node"] == i), key=lambda r: r["cell"]):
                if run + r["w"] >= goal:
                    start = n.low + r["cell"] * step[i]
                    if step[i] == 1 or r["w"] <= TOLERANCE * target:
                        # Settle at the nearer edge of the cell.
                        n.at = start if goal - run <= run + r["w"] - goal else start + step[i]
                        del active[i]
                    else:
                        n.low, n.high, n.below = start, min(n.high, start + step[i]), run
                    break
                run += r["w"]
            else:
                n.at = n.high
                del active[i]


def _literal_rows(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A few rows of numbers as literals in the plan."""
    arrays = [F.lit(list(values)).cast(f"array<{kind}>").alias(name) for values, (name, kind) in zip(zip(*rows), columns.items())]
    return spark.range(1).select(F.explode(F.arrays_zip(*arrays)).alias("row")).select("row.*")


def shard(docs: DataFrame, shards: int, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; shards hold near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    dims = dimensions or default_dimensions(docs)
    # Stored without the texts, each row with a number that stays when tasks are repeated.
    rows = cut(sized.select(F.monotonically_increasing_id().alias("row"), "doc_id", "size", "text_crc32", F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"), *(c.alias(f"_{d}") for d, c in dims.items())))
    names = [f"_{d}" for d in dims]
    groups = cut(rows.groupBy("g1", "g2").agg(F.sum("size").alias("w"), *(F.min(n).alias(n) for n in names)))
    first = groups.agg(F.sum("w").alias("w"), *(f(n).alias(f"{n}{s}") for n in names for s, f in (("low", F.min), ("high", F.max)))).first()
    total = float(first["w"] or 0)
    target = max(1.0, total / shards)

    # Heavy groups (at most HEAVY x shards), largest first into the emptiest shard.
    heavy = sorted(((int(r["w"]), r["g1"], r["g2"]) for r in groups.where(F.col("w") > F.lit(target / HEAVY)).select("g1", "g2", "w").collect()), key=lambda r: (-r[0], r[1], r[2]))
    filled, placed = [0.0] * shards, []
    items = sorted(((w / parts, g1, g2, part, parts) for w, g1, g2 in heavy for parts in [1 if w <= target else -(-w * 4 // int(target))] for part in range(int(parts))), key=lambda x: (-x[0], x[1:]))
    for w, g1, g2, part, parts in items:
        s = min(range(shards), key=lambda k: filled[k])
        filled[s] += w
        placed.append((g1, g2, part, int(parts), s))
    heavy_at = _literal_rows(docs.sparkSession, placed or [(0, 0, -1, 1, 0)], {"g1": "bigint", "g2": "bigint", "part": "int", "parts": "int", "shard": "int"})

    # The tree over all other groups, into the room that is left.
    span = lambda n: max((first[f"{n}high"] or 0) - (first[f"{n}low"] or 0), 1e-12)
    top = (1 << VALUE_BITS) - 1
    tie = F.col("g1").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    coordinate = {n: F.shiftleft(F.coalesce(F.least(F.lit(top), F.floor((F.col(n) - F.lit(first[f"{n}low"])) / F.lit(span(n)) * top)), F.lit(0)).cast("long"), TIE_BITS) + tie for n in names}
    points = groups.join(F.broadcast(heavy_at.select("g1", "g2").distinct()), ["g1", "g2"], "left_anti").select("g1", "g2", "w", *(c.alias(n) for n, c in coordinate.items()))
    # All shards end at one level; those the heavy groups filled beyond it get nothing more.
    level, order = target, sorted(range(shards), key=lambda k: filled[k])
    rest = max(0.0, total - sum(filled))
    for n in range(shards, 0, -1):
        level = (rest + sum(filled[k] for k in order[:n])) / n
        if level >= filled[order[n - 1]]:
            break
    root = Node(list(range(shards)), [max(0.0, level - f) for f in filled])
    while total and any(len(n.shards) > 1 for n in root.leaves()):
        _split_all(points, root, names, target)
    light_at = points.select("g1", "g2", root.walk(lambda n: F.lit(n.shards[0])).alias("shard"))

    parts = F.broadcast(heavy_at.select("g1", "g2", "parts").distinct())
    is_heavy = rows.join(parts, ["g1", "g2"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    columns = ["doc_id", "size", "text_crc32", "row", "shard"]
    sharded = (is_heavy.join(F.broadcast(heavy_at.drop("parts")), ["g1", "g2", "part"]).select(columns)
               .unionByName(rows.join(parts, ["g1", "g2"], "left_anti").join(light_at, ["g1", "g2"]).select(columns)))

    # Slots: numbers within (shard, stored partition), after the counts of earlier partitions.
    sharded = sharded.withColumn("part", F.shiftright("row", 33))
    count = sharded.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = count.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (sharded.withColumn("inside", inside).join(offset, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot")))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in eight shards of near equal bytes; equal texts stay together."""
    return shard(table(spark, sf_dir, "documents", python=False), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
