"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources get shares of a word total by weight; a share stops at ``MOST`` times its
source's words and the excess goes to the others, by weight, until none is above.
A source is then taken whole as often as its target holds it, and once more in part,
block by block:

1. *Units.*  Rows with their size in words.  A hash of the row (and of its number among
   equal rows) is a unit's place in its source's random order.
2. *Blocks.*  Ranges of that order, so many that one has about ``BLOCK_WORDS``
   words; a hot source has more of them, none is larger.
3. *Quotas.*  Whole passes draw every block once.  The last pass draws the first blocks
   up to the rest of the target (sums over groups of blocks, then over the blocks of one
   group) and of the next block the documents that bring it nearest to that rest.
4. *Splitting tree.*  The draws of all sources are dealt out to the shards of the
   output: a node halves its shards and draws the left half's share of each source's
   quota from a multivariate hypergeometric distribution, down to single shards.  Quotas
   are exact, and shards differ by one draw at most.  The tree runs on totals of groups
   of ``GROUP`` sources first, then inside each group in a task of its own.
5. *Draws.*  Each pass goes through a source's blocks in a permuted order of its own;
   a shard owns disjoint stretches of that sequence.  Inside a shard, draws go by a
   hash, and so do the documents of a draw (``draw_order``, ``doc_order``): a local
   shuffle that needs no further exchange than the one by shard.

All random choices are hashes or seeded generators over sorted input: reruns agree,
however the table is split.

Defined results: a null text has no words; documents without words are never drawn (they
add none); a null source is a source, the last one; rows equal in doc_id, source and
text are units of their own, told apart by number only; a source without words has
target 0; a document larger than twice a rest is passed over in the last pass; extra columns
are passed over, also such named like an output; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.llm.common import cut, table
from bazaar.operators.ordering import global_position

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SHARDS, SEED = 16, 20240117
#: Words of a block, sources that one task splits, and the most draws that the generator takes at once.
BLOCK_WORDS, GROUP, MOST_DRAWS = 1 << 16, 4096, 500_000_000
#: Units of a block drawn in part that are chosen by subset sums.
LAST = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Factors of the passes' orders; each pass takes the first that has no divisor in common with the blocks' number.
PRIMES = (1_000_003, 998_244_353, 1_000_000_007, 2_147_483_647)


# -- targets --------------------------------------------------------------------------

def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with each source's ``place`` in order and ``target`` (double) in words.

    Sources by code point, null last, take the weights in turn.  A round gives each
    uncapped source its share of what the capped leave; rounds end when no share is
    above its cap.  Only totals come to the driver.
    """
    placed = cut(global_position(sizes, [F.col("source").asc_nulls_last()], out="place"))
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = placed.select("place", "source", "source_size", weight.cast("double").alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_cap"))
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    capped = F.lit(False)
    while True:
        free, full = weighed.agg(F.sum(F.when(~capped, F.col("_weight"))), F.sum(F.when(capped, F.col("_cap")))).first()
        now = (free, full)
        if now == before or not free:
            break
        level, before = (total - (full or 0.0)) / free, now
        capped = F.col("_weight") * F.lit(level) >= F.col("_cap")
    target = F.when(capped, F.col("_cap")).otherwise(F.col("_weight") * F.lit(level))
    return weighed.select("place", "source", "source_size", target.alias("target"))


# -- splitting tree ---------------------------------------------------------------------

def split_tree(quotas: np.ndarray, room: np.ndarray, seed: list[int]) -> np.ndarray:
    """Draws of each row (source) for each column (shard): rows sum to ``quotas``, columns to ``room``.

    Each node draws its left half's share without replacement from the draws that it has.
    """
    out = np.zeros((len(quotas), len(room)), dtype=np.int64)

    def split(mine: np.ndarray, low: int, high: int):
        if high - low == 1:
            out[:, low] = mine
            return
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).multivariate_hypergeometric(mine, int(room[low:mid].sum()), method="marginals")
        split(left, low, mid)
        split(mine - left, mid, high)

    split(np.asarray(quotas, dtype=np.int64), 0, len(room))
    return out


def equal_room(total: int, shards: int) -> np.ndarray:
    """Draws of each shard: as equal as can be."""
    return np.full(shards, total // shards) + (np.arange(shards) < total % shards)


def _split_groups(rooms: dict[int, list[int]], seed: int):
    """Each source's first draw of every shard, from the sources of whole groups (sorted by group and place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            group = t.column("group")[0].as_py()
            drawn = split_tree(t.column("quota").to_numpy(), np.array(rooms[group]), [seed, 1, group])
            starts = np.concatenate([np.zeros((len(drawn), 1), np.int64), np.cumsum(drawn, axis=1)[:, :-1]], axis=1)
            return pa.RecordBatch.from_arrays([t.column("place").combine_chunks(), pa.array(list(starts), pa.list_(pa.int64()))], ["place", "starts"])

        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and held[0].column("group")[0].as_py() != int(group[a]):
                        yield solved()
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield solved()

    return run


# -- blocks -------------------------------------------------------------------------------

def units(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each document: doc_id, source, size, hash of its text, number among equal rows, place in a random order (0 to 1)."""
    narrow = docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_text"))
    counted = narrow.groupBy("doc_id", "source", "size", "_text").agg(F.count(F.lit(1)).alias("_n"))
    # Numbers in ranges of a thousand, dealt out, so that no task spells out all copies of a row.
    step = 1000
    ranges = counted.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step).cast("long"))))
    dealt = ranges.where(f"_n <= {step}").unionByName(ranges.where(f"_n > {step}").repartition(F.col("doc_id"), F.col("_text"), F.col("_range")))
    each = dealt.withColumn("_copy", F.explode(F.sequence(F.col("_range") * step + 1, F.least((F.col("_range") + 1) * step, F.col("_n"))))).drop("_n", "_range")
    return each.withColumn("_at", _uniform(F.lit(seed), "doc_id", "_text", "_copy"))


def _uniform(*cols) -> Column:
    """A hash as a double from 0 to less than 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def nearest_fit(sizes: list[int], rest: float, last: int = LAST) -> list[bool]:
    """Which of some units to take so that their sizes add up to about ``rest``.

    In order, whatever still fits; of the last ones the subset whose sum comes nearest,
    over or under (reachable sums as the bits of a number, about a million at most).
    """
    head, left, fits = max(0, len(sizes) - last), rest, []
    for size in sizes[:head]:
        fits.append(size <= left)
        left -= size if size <= left else 0
    grain = max(1, int(left) // 1_000_000)
    tail, most, goal = [round(x / grain) for x in sizes[head:]], int(2 * left / grain) + 1, left / grain
    reach = [1]
    for size in tail:
        reach.append((reach[-1] | reach[-1] << size) & ((1 << most + 1) - 1) if size <= most else reach[-1])
    bits = bin(reach[-1])[:1:-1]  # the lowest first
    under, over = bits.rfind("1", 0, int(goal) + 1), bits.find("1", int(goal) + 1)
    at = over if over >= 0 and over - goal < goal - under else under
    taken = []
    for size, before in zip(reversed(tail), reversed(reach[:-1])):
        taken.append(not before >> at & 1)
        at -= size if taken[-1] else 0
    return fits + taken[::-1]


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the blocks that are drawn in part, which units are taken (rows sorted by source and random order; a block is held)."""
    held: list[pa.RecordBatch] = []

    def solved() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        fits = nearest_fit(t.column("size").to_pylist(), t.column("part_rest")[0].as_py())
        return t.set_column(t.column_names.index("fits"), "fits", pa.array(fits, pa.bool_())).to_batches()[0]

    for batch in batches:
        place = batch.column("place").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if held and held[0].column("place")[0].as_py() != int(place[a]):
                    yield solved()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield solved()


def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """All documents with what the mix takes of them.

    doc_id, source, text_hash, size, source_size, target, doc_order (the
    document's order inside a draw) and ``draws``: an array of (pass, shard,
    draw_order) with an entry each time that the document is taken.
    """
    each = cut(units(docs, seed))
    sizes = targets(each.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    total = each.agg(F.sum("size")).first()[0] or 0
    block_words = max(block_words, -(-int(most * total) // MOST_DRAWS))
    number = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(block_words))).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))
    # A rest that is rounding only counts as none.
    sources = cut(sizes.withColumn("blocks", number).withColumn("passes", passes).withColumn("rest", F.when(rest < 1e-9 * F.col("target"), F.lit(0.0)).otherwise(rest)))

    # Units know their source's place and their block.
    known = sources.select(F.col("source").alias("_source"), "place", "blocks", "rest", "source_size", "target")
    based = each.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    based = cut(based.withColumn("block", F.least(F.floor(F.col("_at") * F.col("blocks")).cast("long"), F.col("blocks") - 1)))

    # Where the last pass ends: in which bunch of blocks, then in which block.
    words = cut(based.where("rest > 0 AND size > 0").groupBy("place", "block", "blocks", "rest").agg(F.sum("size").alias("words")))
    width = F.ceil(F.sqrt(F.col("blocks").cast("double"))).cast("long")
    bunched = words.withColumn("bunch", F.floor(F.col("block") / width))
    until = lambda order: F.sum("words").over(Window.partitionBy("place").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    last = (bunched.groupBy("place", "bunch", "rest").agg(F.sum("words").alias("words")).withColumn("until", until("bunch"))
            .where("until > rest AND until - words <= rest").select("place", "bunch", (F.col("until") - F.col("words")).alias("before")))
    ends = (bunched.join(last, ["place", "bunch"]).withColumn("until", F.col("before") + until("block")).where("until > rest AND until - words <= rest")
            .select("place", F.col("block").alias("part"), (F.col("rest") - F.col("until") + F.col("words")).alias("part_rest")))

    # Quotas: blocks of the whole passes, those of the last one, and the one drawn in part.
    quota = F.col("passes") * F.col("blocks") + F.col("whole") + (F.col("part_rest") > 0).cast("long")
    quotas = sources.join(ends, "place", "left").select("place", "blocks", "passes", F.coalesce("part", F.lit(0)).alias("whole"), F.coalesce("part_rest", F.lit(0.0)).alias("part_rest"))
    quotas = cut(quotas.withColumn("quota", quota).withColumn("group", F.floor((F.col("place") - 1) / GROUP).cast("int")))

    # What each block's units are drawn for; of a block drawn in part, those that make up the rest.
    in_part = (F.col("pass") == F.col("passes")) & (F.col("block") == F.col("whole"))
    by_block = draws(quotas, shards, seed).groupBy("place", "block").agg(
        F.collect_list(F.struct("pass", "shard", "draw_order")).alias("draws"), F.max(F.when(in_part, F.col("pass"))).alias("part_pass"), F.max("part_rest").alias("part_rest"))
    drawn = cut(based.where("size > 0").drop("rest", "blocks").join(by_block, ["place", "block"], "left").withColumn("fits", F.col("part_pass").isNull()))
    edge = drawn.where("NOT fits").repartition("place").sortWithinPartitions("place", "_at", "doc_id", "_text", "_copy")
    marked = drawn.where("fits").unionByName(edge.mapInArrow(_fitting, drawn.schema))
    marked = marked.withColumn("draws", F.when(F.col("fits"), F.col("draws")).otherwise(F.filter("draws", lambda d: d["pass"] < F.col("part_pass"))))
    wordless = based.where("size = 0").withColumn("draws", F.lit(None).cast(drawn.schema["draws"].dataType))
    names = ["doc_id", "source", F.col("_text").alias("text_hash"), "size", "source_size", "target", F.xxhash64(F.lit(seed), F.lit(2), "doc_id", "_text", "_copy").alias("doc_order"),
             F.coalesce("draws", F.array().cast(drawn.schema["draws"].dataType)).alias("draws")]
    return marked.select(*names).unionByName(wordless.select(*names))


def draws(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Every draw of a block, with its pass, shard and draw_order, beside the columns of ``quotas`` (place, blocks, passes, whole, quota, group)."""
    rooms = {}
    per_group = sorted((r["group"], r["n"]) for r in quotas.groupBy("group").agg(F.sum("quota").alias("n")).collect())  # a row for GROUP sources
    sums = np.array([n for _, n in per_group], dtype=np.int64)
    if len(sums):
        rooms = dict(zip((g for g, _ in per_group), split_tree(sums, equal_room(int(sums.sum()), shards), [seed, 0]).tolist()))
    in_groups = quotas.select("group", "place", "quota").repartition("group").sortWithinPartitions("group", "place")
    starts = cut(in_groups.mapInArrow(_split_groups(rooms, seed), "place long, starts array<long>"))
    # Blocks one by one, a hot source's spread over the tasks: ranges of a thousand first.
    step = 1000
    ranges = quotas.where("quota > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / step).cast("long"))).alias("range")).repartition(F.col("place"), F.col("range"))
    numbers = ranges.withColumn("at", F.explode(F.sequence(F.col("range") * step, F.least((F.col("range") + 1) * step, F.col("quota")) - 1))).drop("range")
    which = F.floor(F.col("at") / F.col("blocks")).cast("long")
    # Sequence number ``at``: a block of the pass that it falls in.  The last pass has fewer blocks.
    of_pass = numbers.withColumns({"pass": which, "block": F.col("at") - which * F.col("blocks")})
    length = F.when(F.col("pass") < F.col("passes"), F.col("blocks")).otherwise(F.col("quota") - F.col("passes") * F.col("blocks"))
    factor = F.coalesce(*[F.when(length % p != 0, F.lit(p)) for p in PRIMES]).cast("long")
    shift = F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "place", "pass"), length)
    permuted = F.pmod(F.pmod(F.col("block"), length) * F.pmod(factor, length) + shift, length)
    placed = of_pass.withColumn("block", permuted).join(starts, "place")
    shard = F.size(F.filter("starts", lambda x: x <= F.col("at"))) - 1
    return placed.withColumns({"shard": shard, "draw_order": F.xxhash64(F.lit(seed), F.lit(1), "place", "pass", "block")})


def shuffled(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """The mix's documents, text included: a row each time one is taken, by shard and in the shard's random order.

    Written out, the files hold the shards in their order.
    """
    rows = mixed.select("doc_id", "source", "text_hash", "doc_order", F.explode("draws").alias("_d")).select("doc_id", "source", "text_hash", "doc_order", "_d.*")
    texts = docs.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_hash")).agg(F.min("text").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("text_hash") == F.col("_hash"))
    order = ["shard", "draw_order", "doc_order"]
    return rows.join(texts, same).drop("_id", "_source", "_hash", "text_hash").repartitionByRange(*order).sortWithinPartitions(*order)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each of ``documents``, sources weighing 3, 1, 2 in turn."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))
