"""Near-duplicate join on word shingles with a MinHash LSH forest.

Each text gets ``TREES`` labels of ``DEPTH`` MinHash values; a tree is the prefix
trie of all texts' labels of one number.  Two texts of similarity s agree on the
first x values of a label with probability s**x, so x starts at the whole label
and is shortened until 1 - (1 - s**x)**TREES reaches the target recall at the
threshold; the trie nodes of that depth hold all candidates (those of longer
matches included).  Candidates are verified by exact Jaccard similarity of their
shingle sets.

How it runs:

1. Equal texts are one class from the start (their first id stands for them).
2. A node is named by the bytes of its label prefix.  Node sizes are counted with
   partial sums; only nodes of two and more go on.
3. Members meet in their node with their signatures alone.  A pair belongs to the
   first tree in which its prefixes agree, so it is looked at once, and only if
   its signatures agree on a share within five standard deviations of the
   threshold.  Which members have such a pair is all that leaves the node.
4. The texts of those members go to the nodes where they have a pair; there the
   shingle sets are intersected.  Out come, per member, its number of links and
   the least member it hangs together with: rows per member, not per pair.
5. A node of over ``TILE`` members or ``TILE_BYTES`` of text is dealt out in tiles, and each
   pair of tiles is a unit of work of its own: no pair is lost and no task holds more
   than two tiles.
6. Components of the member-to-least edges by alternating large-star and small-star
   steps, each written to the shared folder.

Where only the classes are wanted (``one_of_each``), connectivity comes first, from the
longest prefixes to the shortest:

a. Each text is verified against one text alone, the least that shares a whole label with
   it.  That unites nearly all of a large group with one comparison a member.
b. The prefixes are shortened.  Nodes whose members are all of one class by now need no
   look; in the others only pairs across classes are verified.  Tiles follow the
   classes, so a large class meets the few others of its node, not itself: rows grow with
   its size, not with the square.

Defined results: a null text counts as empty; texts without words have no links
(equal ones share a class); a text of fewer words than a shingle is one shingle of
all its words; rows equal in all columns are copies of one text; the class id is
the least doc_id of the component (null ids come last, and a class of null ids
has the id null); extra columns are passed over; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.llm.common import NEAR, cut, mix64, released, shingle_hashes, table

TREES, DEPTH, RECALL = 20, 8, 0.9995
TILE, TILE_BYTES = 1000, 8 << 20
#: Members of a unit where only classes are wanted.
CHUNK = 400


def prefix_depth(threshold: float = NEAR, recall: float = RECALL) -> int:
    """The longest prefix at which pairs of the threshold's similarity meet with the target recall."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold ** depth) ** TREES < recall:
        depth -= 1
    return depth


_FACTORS = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH MinHash values, 16 bits each."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (_FACTORS[:, None] * shingles[None, i:i + 1024]).min(axis=1), out=least)
    return (mix64(least) >> np.uint64(48)).astype(np.uint16).reshape(TREES, DEPTH)


def similar(sets: list[np.ndarray], pair: np.ndarray, threshold: float) -> np.ndarray:
    """Of the marked pairs (a symmetric matrix) those whose sets reach the threshold."""
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.astype(np.int32)
    mark, out = np.zeros(int(code.max()) + 1, dtype=bool), np.zeros_like(pair)
    for a in range(len(sets)):
        others = np.flatnonzero(pair[a, a + 1:]) + a + 1
        if not len(others):
            continue
        mine = code[first[a]:first[a] + size[a]]
        mark[mine] = True
        for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(size[others]) >> 20)) + 1):  # a million shingles at a time
            edge = np.cumsum(size[some]) - size[some]
            at = np.repeat(first[some] - edge, size[some]) + np.arange(int(size[some].sum()))
            both = np.add.reduceat(mark[code[at]], edge, dtype=np.int64)
            good = some[both >= threshold * (size[a] + size[some] - both) - 1e-9]
            out[a, good] = out[good, a] = True
        mark[mine] = False
    return out


def plausible(sign: np.ndarray, tree: int, depth: int, tile: np.ndarray, i: int, j: int, threshold: float) -> np.ndarray:
    """Pairs of a node (as a symmetric matrix) that are its to verify: first met here, similar enough by signature."""
    n, flat = len(sign), sign.reshape(len(sign), -1)
    floor = threshold - 5 * np.sqrt(threshold * (1 - threshold) / flat.shape[1])
    agree, earlier = np.zeros((n, n), dtype=np.uint16), np.zeros((n, n), dtype=bool)
    here = np.ones((n, n), dtype=bool)
    for t in range(TREES):
        same = np.ones((n, n), dtype=bool)
        for d in range(DEPTH):
            equal = sign[:, t, d][:, None] == sign[:, t, d][None, :]
            agree += equal
            if d < depth:
                same &= equal
        if t < tree:
            earlier |= same
        elif t == tree:
            here = same
    pair = here & ~earlier & (agree >= floor * flat.shape[1])
    np.fill_diagonal(pair, False)
    if i != j:  # of two tiles, only pairs across
        pair &= tile[:, None] != tile[None, :]
    return pair


def least_reached(pair: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix, the least index it hangs together with."""
    n = len(pair)
    label = np.arange(n)
    while True:
        least = np.concatenate([np.where(pair[i:i + 256], label[None, :], n).min(axis=1, initial=n) for i in range(0, n, 256)])
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


# -- node work ------------------------------------------------------------------------------

def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one unit (tree, key, i, j) after the other; they arrive in that order."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(c).to_numpy() for c in ("tree", "key", "i", "j")]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *new.tolist(), len(t)]
        for a, b in zip(edges, edges[1:]):
            name = tuple(int(c[a]) for c in cols)
            if name != last and held:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = name
    if held:
        yield pa.concat_tables(held)


def _node(t: pa.Table):
    sign = np.frombuffer(b"".join(t.column("sign").to_pylist()), dtype=np.uint16).reshape(-1, TREES, DEPTH)
    return sign, int(t.column("tree")[0].as_py()), t.column("tile").to_numpy(), int(t.column("i")[0].as_py()), int(t.column("j")[0].as_py())


def _candidates(t: pa.Table, depth: int, threshold: float) -> np.ndarray:
    """The pairs of a unit that are its to verify; of classes, if known, only pairs across."""
    sign, tree, tile, i, j = _node(t)
    pair = plausible(sign, tree, depth, tile, i, j, threshold)
    if "class" in t.column_names:
        known = t.column("class").to_numpy()
        pair &= known[:, None] != known[None, :]
    return pair


def _wanted(depth: int, threshold: float):
    """The members of units that have a pair to verify."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for t in _nodes(batches):
            if len(t) < 2:
                continue
            some = _candidates(t, depth, threshold).any(axis=1)
            if some.any():
                out.append(t.filter(pa.array(some)))
                size += len(out[-1])
                if size > 5000:
                    yield pa.concat_tables(out).combine_chunks().to_batches()[0]
                    out, size = [], 0
        if out:
            yield pa.concat_tables(out).combine_chunks().to_batches()[0]

    return run


def _links(depth: int, threshold: float):
    """Links (0 where classes are known) and least connected member (or class) of the members of units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for t in _nodes(batches):
            pair = _candidates(t, depth, threshold)
            some = np.flatnonzero(pair.any(axis=1))
            if not len(some):
                continue
            name = t.column("class" if "class" in t.column_names else "text_id").to_numpy()[some]
            pair = pair[np.ix_(some, some)]
            order = np.argsort(name, kind="stable")
            name, pair = name[order], pair[np.ix_(order, order)]
            pair = similar([np.unique(shingle_hashes(t.column("text")[int(k)].as_py())) for k in some[order]], pair, threshold)
            links = pair.sum(axis=1)
            root = name[least_reached(pair)]
            for k in np.flatnonzero(links):
                out.append((int(name[k]), int(links[k]), int(root[k])))
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["text_id", "links", "root"])

    return run


def _followers(threshold: float):
    """(text_id, head) of the texts near to their unit's head, which comes first in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            found = []
            for lead, me, text in zip(*(batch.column(c) for c in ("head", "text_id", "text"))):
                lead, me = lead.as_py(), me.as_py()
                if lead != me and lead != head:
                    continue
                mine = np.unique(shingle_hashes(text.as_py()))
                if lead == me:
                    head, own = lead, mine
                    continue
                at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                both = int((own[at] == mine).sum())
                if both >= threshold * (len(own) + len(mine) - both) - 1e-9:
                    found.append((me, lead))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["text_id", "head"])

    return run


# -- components ---------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, from edges (u, v) of two longs.

    Alternating large-star and small-star steps; a step joins edges to the least
    neighbour per node, so no neighbourhood is ever gathered, and is written out.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = state(edges)
    while now[0]:
        out = both_ways(edges)
        least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = out.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # all edges lead to smaller nodes
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        now, before = state(edges), now
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


# -- Spark ----------------------------------------------------------------------------------------

def text_name() -> list[Column]:
    """A text is known by two 64-bit hashes; ``text_id`` is one of them, the other guards against collisions."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("text_id"), F.xxhash64(F.lit(1), text).alias("guard")]


def _signed(named: DataFrame) -> DataFrame:
    """One row per text: text_id, guard, first_id (least id of its rows), n_copies, n_bytes, sign (null: no words)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = []
            for text in batch.column("text"):
                shingles = shingle_hashes(text.as_py())
                signs.append(signature(shingles).tobytes() if len(shingles) else None)
            names = ["doc_id", "text_id", "guard", "n_bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(signs, pa.binary())], [*names, "sign"])

    kind = named.schema["doc_id"].dataType.simpleString()
    signed = named.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(released(sign), f"doc_id {kind}, text_id long, guard long, n_bytes long, sign binary")
    return cut(signed.groupBy("text_id", "guard").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.max("n_bytes").alias("n_bytes"), F.first("sign").alias("sign")))


def _members(texts: DataFrame, depth: int, *columns: str) -> DataFrame:
    """A row for each text and tree: the node of its label's first ``depth`` values."""
    width = 2 * DEPTH  # bytes of a label
    nodes = F.array(*(F.xxhash64(F.substring("sign", width * t + 1, 2 * depth)) for t in range(TREES)))
    return texts.where("sign IS NOT NULL").select("text_id", *columns, F.posexplode(nodes).alias("tree", "key"))


def _fetched(named: DataFrame, texts: DataFrame, places: DataFrame) -> DataFrame:
    """text_id, text and the places (``at``) of some texts.

    Of equal texts, the first document's is read.  The id is part of the join's key, so
    the copies of a text are spread; rows equal in id and text, and copies without id,
    all match, and one of them stays (partial sums before the shuffle).
    """
    holders = places.join(texts.select("text_id", "guard", "first_id"), "text_id").select(F.col("text_id").alias("_t"), F.col("guard").alias("_g"), "first_id", "at")
    first = (F.col("text_id") == F.col("_t")) & (F.col("guard") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    fetched = named.join(holders, first).groupBy("text_id", "guard").agg(F.first("text").alias("text"), F.first("at").alias("at"))
    return fetched.select("text_id", "text", F.explode("at").alias("at")).select("text_id", "text", "at.*")


_UNIT = ["tree", "key", "i", "j"]


def _verified(named: DataFrame, texts: DataFrame, work: DataFrame, depth: int, threshold: float) -> DataFrame:
    """text_id, links, root of the members of some units (``work``: text_id, tree, key, i, j, tile and perhaps class)."""
    more = ["class"] if "class" in work.columns else []
    kinds = "tree int, key long, i int, j int, tile int, text_id long, sign binary" + ", class long" * len(more)
    with_sign = work.join(texts.select("text_id", "sign"), "text_id").select(*_UNIT, "tile", "text_id", "sign", *more)
    wanted = cut(with_sign.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(released(_wanted(depth, threshold)), kinds))
    places = wanted.groupBy("text_id").agg(F.collect_list(F.struct(*_UNIT, "tile", "sign", *more)).alias("at"))
    bodies = _fetched(named, texts, places)
    return cut(bodies.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(released(_links(depth, threshold)), "text_id long, links long, root long"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *text_name())


def text_classes(docs: DataFrame, threshold: float = NEAR, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """One row per text: text_id, guard, first_id (least id of its rows), n_copies, root (names its class), n_links (null: none)."""
    depth, named = prefix_depth(threshold, recall), _named(docs)
    texts = _signed(named)
    members = _members(texts, depth, "n_bytes")
    # Stored, so that the join's two sides are plain shuffles and Spark can split a hot node.
    nodes = cut(members.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes")).where("n > 1")
                .select("tree", "key", F.ceil(F.greatest(F.col("n") / F.lit(tile), F.col("n_bytes") / F.lit(TILE_BYTES))).cast("int").alias("tiles")))
    mine = F.pmod(F.xxhash64("text_id", F.lit(5)), F.col("tiles")).cast("int")
    shared = members.drop("n_bytes").join(nodes, ["tree", "key"]).withColumn("tile", mine)
    work = (shared.select("text_id", "tree", "key", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
            .select("text_id", "tree", "key", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    verified = _verified(named, texts, work, depth, threshold)

    links = verified.groupBy("text_id").agg(F.sum("links").alias("n_links"))
    roots = components(verified.select(F.col("text_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "text_id")
    return (texts.select("text_id", "guard", "first_id", "n_copies").join(roots, "text_id", "left").join(links, "text_id", "left")
            .withColumn("root", F.coalesce("root", "text_id")))


def _stars(named: DataFrame, texts: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(text_id, head): texts near to the least text that shares a whole label with them."""
    members = _members(texts, DEPTH)
    nodes = cut(members.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n"), F.min("text_id").alias("head")).where("n > 1").drop("n"))
    led = cut(members.join(nodes, ["tree", "key"]).groupBy("text_id").agg(F.min("head").alias("head")).where("head <> text_id"))
    heads = cut(led.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks")))
    follow = led.join(heads, "head").select("text_id", "head", F.pmod(F.xxhash64("text_id", F.lit(6)), F.col("chunks")).cast("int").alias("chunk"))
    lead = heads.select(F.col("head").alias("text_id"), "head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    places = follow.unionByName(lead).groupBy("text_id").agg(F.collect_list(F.struct("head", "chunk")).alias("at"))
    bodies = _fetched(named, texts, places).repartition("head", "chunk").sortWithinPartitions("head", "chunk", F.col("text_id") != F.col("head"))
    return cut(bodies.select("head", "text_id", "text").mapInArrow(released(_followers(threshold)), "text_id long, head long"))


def text_roots(docs: DataFrame, threshold: float = NEAR, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """One row per text: text_id, guard, first_id, root (names its class), without counting links."""
    depth, named = prefix_depth(threshold, recall), _named(docs)
    texts = _signed(named)
    united = components(_stars(named, texts, threshold, chunk).select(F.col("text_id").alias("u"), F.col("head").alias("v"))).select(F.col("node").alias("text_id"), F.col("root").alias("class"))
    classed = cut(texts.join(united, "text_id", "left").withColumn("class", F.coalesce("class", "text_id")))

    # Nodes of several classes.  A class that fills a tile has tiles of its own, the small ones share.
    node, members = ["tree", "key"], _members(classed, depth, "class", "n_bytes")
    held = members.groupBy(*node, "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))
    held = cut(held.withColumn("load", F.greatest(F.col("n") / F.lit(chunk), F.col("n_bytes") / F.lit(TILE_BYTES))))
    several = cut(held.groupBy(*node).agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.ceil(F.sum(F.when(F.col("load") <= 1, F.col("load")))).cast("int").alias("shared"),
                                          F.sum(F.when(F.col("load") > 1, F.ceil("load"))).cast("int").alias("own"))
                  .where("lo <> hi").select(*node, F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("own", F.lit(0)).alias("own")))
    large = held.where("load > 1").select(*node, "class", F.ceil("load").cast("int").alias("tiles"))
    before = F.sum("tiles").over(Window.partitionBy(*node).orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
    large = cut(large.join(several.select(*node), node, "left_semi").withColumn("start", F.coalesce(before, F.lit(0)).cast("int")))
    placed = members.select("text_id", "class", *node).join(several, node).join(large, [*node, "class"], "left")
    at = F.xxhash64("text_id", F.lit(5))
    tile = F.when(F.col("tiles").isNull(), F.pmod(at, F.col("shared"))).otherwise(F.col("shared") + F.col("start") + F.pmod(at, F.col("tiles"))).cast("int")
    low, high = F.col("shared") + F.col("start"), F.col("shared") + F.col("start") + F.col("tiles")
    all_tiles = F.sequence(F.lit(0), F.col("shared") + F.col("own") - 1)
    others = F.when(F.col("tiles").isNull(), all_tiles).otherwise(F.filter(all_tiles, lambda x: (x < low) | (x >= high)))
    work = (placed.select("text_id", "class", *node, tile.alias("tile"), F.explode(others).alias("other"))
            .select("text_id", "class", *node, "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")))
    across = _verified(named, classed, work, depth, threshold)

    merged = components(across.select(F.col("text_id").alias("u"), F.col("root").alias("v")).distinct()).select(F.col("node").alias("class"), "root")
    return classed.select("text_id", "guard", "first_id", "class").join(merged, "class", "left").select("text_id", "guard", "first_id", F.coalesce("root", "class").alias("root"))


def near_classes(docs: DataFrame, threshold: float = NEAR, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (different texts at the threshold or above), n_copies (rows of its text)."""
    grouped = text_classes(docs, threshold, recall, tile)
    # Classes are named by their least id; only components of several texts need the aggregation.
    least = grouped.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named_classes = grouped.join(least, "root").select("text_id", "guard", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return docs.select("doc_id", *text_name()).join(named_classes, ["text_id", "guard"]).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, threshold: float = NEAR, chunk: int = CHUNK) -> DataFrame:
    """The first document of each near-duplicate class, all columns as they are: exactly one row a class.

    First is the least doc_id (rows without id come last), then the least text
    hash; of rows equal in both one stays.
    """
    me = F.struct(F.col("first_id").isNull().alias("last"), "first_id", "text_id", "guard")
    heads = text_roots(docs, threshold, chunk=chunk).groupBy("root").agg(F.min(me).alias("head")).select(F.col("head.first_id").alias("_id"), F.col("head.text_id").alias("_t"), F.col("head.guard").alias("_g"))
    name = text_name()
    kept = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (name[0] == F.col("_t")) & (name[1] == F.col("_g")), "left_semi")
    name = [F.xxhash64("doc_id"), name[0]]
    again = docs.groupBy(name[0].alias("_i"), name[1].alias("_t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return kept
    kept = kept.withColumns({"_i": name[0], "_t": name[1]})
    once = kept.join(again, ["_i", "_t"], "left_anti")
    return once.unionByName(kept.join(again, ["_i", "_t"], "left_semi").dropDuplicates(["_i", "_t"])).select(*docs.columns)


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``: five-word shingles, similarity 0.8 or more."""
    return near_classes(table(spark, sf_dir, "documents"))


#: Exact similarities of all pairs of texts that share a shingle, and components by propagation.
ORACLE = r"""
WITH RECURSIVE named AS (SELECT doc_id, ifnull(text, '') AS t FROM documents),
texts AS (SELECT t, min(doc_id) AS id, count(*) AS n_copies FROM named GROUP BY t),
words AS (SELECT id, list_filter(regexp_split_to_array(t, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM texts),
sh AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
size AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
pair AS (SELECT a, b FROM shared JOIN size x ON x.id = a JOIN size y ON y.id = b WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)),
reach(id, root) AS (SELECT id, id FROM texts UNION SELECT p.b, r.root FROM reach r JOIN pair p ON p.a = r.id WHERE r.root < p.b),
class AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id),
links AS (SELECT a AS id, count(*) AS n_links FROM pair GROUP BY a)
SELECT named.doc_id, class_id, ifnull(n_links, 0) AS n_links, n_copies
FROM named JOIN texts USING (t) JOIN class USING (id) LEFT JOIN links USING (id)
"""
