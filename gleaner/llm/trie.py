"""Prefix trie of conversations, held as balanced parentheses per shard.

Every distinct sequence of first turns is a node. Its identity is its depth and 128
bits folded from the hashes of its turns and their places, so that nodes are found by
one running fold per conversation and one aggregate, however deep a conversation is.

What a node sums over its subtree comes from the parentheses. Leaf paths are sorted and
dealt into shards by sampled ranges. A shard lists the nodes of its paths in preorder,
writes their parentheses, and keeps the least excess of blocks of it in a range min-max
tree. ``findclose`` delimits a subtree; the rank of leaf pairs "()" before and after it
counts its leaves, and a cumulative array over opening parentheses gives its savings. A
node on the paths of several shards, the shared spine, stands in each of them; every
leaf path is in one shard and a node's own savings count on its smallest leaf path only,
so that sums over the shards are whole.

Nodes with one member head a chain without branches: such a chain is one leaf and saves
nothing, and only its top enters a shard.

Defined cases: turns stand in the order of ``turn``, null first; rows of one turn follow
in an order fixed by their content, equal rows one after the other. A null role or text
is empty. Rows without a conversation id are left out. A conversation without turns is a
member of the root and ends there. An empty table gives no node, not even a root. Long
texts are hashed whole. Columns other than the four named are not looked at. A shard
holds whole paths: one path of more shared nodes than a shard is one task all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.frames import same_key
from gleaner.plans.scale import cut_lineage, running_sum_within, running_within, sized_chunks

WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS = 1 << 19
SORT_DEPTH = 8  # turns that order the paths; deeper ties only make spines longer
KEY = ["depth", "k1", "k2"]


class Parentheses:
    """Balanced parentheses of a tree given by its preorder depths; places count from 0."""

    BLOCK = 128

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.opens = 2 * np.arange(n) - (depth - depth[:1])
        self.bits = np.zeros(2 * n, bool)
        self.bits[self.opens] = True
        self.excess = np.cumsum(np.where(self.bits, 1, -1).astype(np.int32), dtype=np.int32)
        blocks = max(1, -(-2 * n // self.BLOCK))
        self.width = 1 << (blocks - 1).bit_length()
        padded = np.full(self.width * self.BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: 2 * n] = self.excess
        self.rows = padded.reshape(self.width, self.BLOCK)
        # least excess of every block and of every pair above: node i stands over 2i and 2i + 1
        self.least = np.empty(2 * self.width, np.int32)
        self.least[self.width :] = self.rows.min(1)
        for level in range(self.width.bit_length() - 1, 0, -1):
            lo, hi = 1 << (level - 1), 1 << level
            self.least[lo:hi] = np.minimum(self.least[2 * lo : 2 * hi : 2], self.least[2 * lo + 1 : 2 * hi : 2])
        self.ranks = np.append(0, np.cumsum(self.bits))
        pairs = self.bits.copy()
        pairs[:-1] &= ~self.bits[1:]
        self.pairs = np.append(0, np.cumsum(pairs))

    def findclose(self, places: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        step = 1 << 13
        parts = [self._findclose(places[i : i + step]) for i in range(0, len(places), step)]
        return np.concatenate(parts) if parts else places

    def _findclose(self, places: np.ndarray) -> np.ndarray:
        want = self.excess[places] - 1
        block = places // self.BLOCK
        inside = (self.rows[block] <= want[:, None]) & (np.arange(self.BLOCK) > (places % self.BLOCK)[:, None])
        near = inside.any(1)
        node = block + self.width
        climbing = ~near
        while climbing.any():  # to the first block on the right that goes as low
            right = climbing & (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.width - 1)] <= want)
            node[right] += 1
            climbing &= ~right
            node[climbing] //= 2
        down = ~near & (node < self.width)
        while down.any():
            left = 2 * node[down]
            node[down] = np.where(self.least[left] <= want[down], left, left + 1)
            down &= node < self.width
        block = np.where(near, block, node - self.width)
        first = np.where(near[:, None], inside, self.rows[block] <= want[:, None]).argmax(1)
        return block * self.BLOCK + first

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Opening parentheses before each place."""
        return self.ranks[places]

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Leaf pairs inside each subtree."""
        return self.pairs[closes] - self.pairs[opens]


def subtree_sums(place: np.ndarray, depth: np.ndarray, k1: np.ndarray, k2: np.ndarray, own: np.ndarray):
    """(node rows, leaves, sums of own) of the trie over paths, given as rows in order of (place, depth).

    Rows of a path run from depth 0 without gaps; equal keys at one depth are one node if the
    paths stand side by side.
    """
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    path = np.cumsum(np.append(True, place[1:] != place[:-1])) - 1
    size = np.diff(np.append(start, len(place)))
    before = start[np.maximum(path - 1, 0)] + depth  # the row of the path before at the same depth
    known = (path > 0) & (depth < size[np.maximum(path - 1, 0)])
    before = np.where(known, before, 0)
    known &= (k1[before] == k1) & (k2[before] == k2)
    # own may stand on a later path through the node: add it to the first
    by_depth = np.lexsort((np.arange(len(place)), depth))
    node_of = np.empty(len(place), np.int64)
    node_of[by_depth] = np.maximum.accumulate(np.where(known[by_depth], 0, np.arange(len(place))))
    node_of = by_depth[node_of]
    new = np.flatnonzero(~known)
    total = np.zeros(len(place), np.int64)
    np.add.at(total, node_of, own)
    tree = Parentheses(depth[new])
    closes = tree.findclose(tree.opens)
    sums = np.append(0, np.cumsum(total[new]))
    return new, tree.leaves(tree.opens, closes), sums[tree.rank(closes)] - sums[tree.rank(tree.opens)]


def _hashes(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(role, text).alias("a1"), F.xxhash64(F.lit(7), text, role).alias("a2")]


def ordered_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, a1, a2, words): the turns of every conversation numbered from 1, as hashes and word counts."""
    said, who = (F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in (text, role))
    rows = convs.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("t"), *_hashes(who, said),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))
    order = ["t", "a1", "a2"]
    parts = sized_chunks(rows, ["c"], order, F.lit(0))
    return running_sum_within(parts, ["c"], order, F.lit(1), "pos", F.col("_part")).select("c", "pos", "a1", "a2", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (c, depth, a1, a2, words, len) and conversations (c, len) after borrowing first turns.

    Conversation c takes the first h turns of c - c % ``every`` and its own from the h-th on,
    where h is crc32 of the decimal c modulo ``most``.
    """
    turns = cut_lineage(turns)
    sizes = turns.groupBy("c").agg(F.count("*").alias("n")).withColumn(
        "h", F.crc32(F.col("c").cast("string")) % most).withColumn("donor", F.col("c") - F.col("c") % every)
    given = sizes.select(F.col("c").alias("donor"), F.col("n").alias("given"))
    sizes = sizes.join(given, "donor", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    sizes = cut_lineage(sizes.select(
        "c", "donor", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    heads = turns.where((F.col("c") % every == 0) & (F.col("pos") < most)).withColumnRenamed("c", "donor")
    first = sizes.join(heads, "donor").where("pos <= h").select("c", F.col("pos").alias("depth"), "a1", "a2", "words", "len")
    own = turns.join(sizes, "c").where("pos > h").select(
        "c", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "a1", "a2", "words", "len")
    return first.unionByName(own), sizes.select("c", "len")


def _same_node(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return same_key(left, right, dict(zip(KEY, names)))


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): the digest of the ids that end at each node, comma-joined in order.

    Ids travel as joined strings of at most 4,096 neighbours, and the digest reads these one by one.
    """
    ends = paths.where("depth = len").select(*KEY, "c").unionByName(
        convs.where("len = 0").select(*[F.lit(0).cast(t).alias(n) for n, t in zip(KEY, ("long",) * 3)], "c"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy(*KEY, F.shiftright("c", 12).alias("part")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for b in batches:
            out = []
            for *now, ids in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(out)
        if key is not None:
            yield _rows([(*key, digest.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [*KEY, "ends"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(run, "depth long, k1 long, k2 long, ends string")


def _shard_sums(rows: DataFrame, n_shards: int) -> DataFrame:
    """(depth, k1, k2, leaves, saved): subtree sums of every node in every shard it stands in."""
    names = ["shard", "place", "depth", "k1", "k2", "own"]
    dealt = rows.select(*[F.col(n).cast("long") for n in names]).repartition(n_shards, "shard").sortWithinPartitions("shard", "place", "depth")

    def one(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        _, place, depth, k1, k2, own = (np.concatenate(c) for c in zip(*parts))
        new, leaves, saved = subtree_sums(place, depth, k1, k2, own)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (depth[new], k1[new], k2[new], leaves, saved)], [*KEY, "leaves", "saved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for b in batches:
            table = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cuts = np.flatnonzero(table[0][1:] != table[0][:-1]) + 1
            for i, j in zip(np.append(0, cuts).tolist(), np.append(cuts, b.num_rows).tolist()):
                if i == j:
                    continue
                piece = [c[i:j] for c in table]
                if kept and kept[-1][0][0] != piece[0][0]:
                    yield one(kept)
                    kept = []
                kept.append(piece)
        if kept:
            yield one(kept)

    return dealt.mapInArrow(run, "depth long, k1 long, k2 long, leaves long, saved long")


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: (conv, depth, parent_conv, n_convs, n_children, n_leaves, saved, ends).

    ``turns`` are (c, depth, a1, a2, words, len) and ``convs`` (c, len), as ``rebuilt`` gives them;
    every conversation has one row in ``convs`` and its turns are numbered from 1.
    """
    salted = turns.select(
        "c", F.col("depth").cast("long").alias("depth"), "words", "len",
        F.xxhash64(F.col("depth").cast("long"), "a1").alias("o1"), F.xxhash64(F.lit(7), F.col("depth").cast("long"), "a2").alias("o2"))
    salted = cut_lineage(salted)
    parts = sized_chunks(salted, ["c"], ["depth"], F.lit(0))
    folded = running_within(parts, ["c"], ["depth"], {"k1": F.col("o1"), "k2": F.col("o2")}, F.col("_part"),
                            F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    paths = cut_lineage(folded.select(
        "c", *KEY, "words", "len", F.col("k1").bitwiseXOR(F.col("o1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("o2")).alias("p2")))

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(n) for n in KEY], "conv", "n_convs", zero.alias("words"), none.alias("p1"), none.alias("p2"))
    nodes = cut_lineage(paths.groupBy(*KEY).agg(
        F.min("c").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")).unionByName(root))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("pd"), "p1", "p2").agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({"p1": "pk1", "p2": "pk2"})
    tree = cut_lineage(nodes.join(children, _same_node(nodes, children, ["pd", "pk1", "pk2"]), "left").select(
        *nodes.columns, F.coalesce("n_children", zero).alias("n_children")))

    # leaf paths: of the smallest member of every childless node, down to the first node of one member
    leaf = tree.where("n_children = 0 AND depth > 0").select(F.col("conv").alias("c"))
    on_leaf = cut_lineage(paths.select("c", *KEY).join(leaf, "c", "left_semi"))
    owner = on_leaf.groupBy(*KEY).agg(F.min("c").alias("owner"))
    up = tree.select(F.col("depth").alias("ud"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("n_convs").alias("above"), F.col("conv").alias("parent_conv"))
    named = tree.withColumn("ud0", F.col("depth") - 1)
    full = cut_lineage(named.join(
        up, (named["ud0"] == up["ud"]) & (named["p1"] == up["u1"]) & (named["p2"] == up["u2"]), "left").select(
        *tree.columns, "above", "parent_conv"))
    weighed = cut_lineage(full.where("depth > 0 AND (n_convs > 1 OR above > 1)").join(owner, KEY).select(
        *KEY, "owner", ((F.col("n_convs") - 1) * F.col("words")).alias("own")))
    rows = cut_lineage(on_leaf.join(weighed, KEY).select(
        "c", *KEY, F.when(F.col("c") == F.col("owner"), F.col("own")).otherwise(zero).alias("own")))

    lines = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.when(
        F.col("depth") <= SORT_DEPTH, F.struct("depth", "k1", "k2")))).alias("path"))
    n_shards = rows.count() // shard_rows + 1
    dealt = cut_lineage(lines.repartitionByRange(n_shards, "path", "c").withColumn("shard", F.spark_partition_id()))
    dealt = cut_lineage(dealt.select("c", "shard", F.row_number().over(Window.partitionBy("shard").orderBy("path", "c")).alias("place")))
    top = dealt.select("shard", "place", *[zero.alias(n) for n in (*KEY, "own")])
    placed = rows.join(dealt, "c").select("shard", "place", *KEY, "own").unionByName(top)
    sums = _shard_sums(placed, n_shards).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    ends = _ends(paths, convs)
    nothing = hashlib.sha256(b"").hexdigest()
    return full.join(sums, KEY, "left").join(ends, KEY, "left").select(
        "conv", "depth", "parent_conv", "n_convs", "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", zero).alias("saved"),
        F.coalesce("ends", F.lit(nothing)).alias("ends"))
