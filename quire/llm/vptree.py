"""SimHash near-duplicates by vantage-point trees over fingerprints.

Equal fingerprints are one node. A tree over a bounded sample of the nodes cuts Hamming space into shards: a node
goes to the shard of its side, and visits shards whose border is within the radius (triangle bound). Shards that are still too large
are cut again in the same way by trees over samples of their own, as often as it takes. In the end each shard is cut by a
tree in its task and compared leaf by leaf; it reports a star for each group of linked nodes, never all pairs. Stars
meet in connected components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, slices, words_of

#: Nodes a shard should hold, and a leaf inside a shard.
SHARD, LEAF = 4096, 512
#: One node in SAMPLE builds a tree over shards, and no more than MOST_SAMPLED (expected number); so a tree has fewer leaves than LEAVES.
SAMPLE, MOST_SAMPLED, LEAVES = 16, 1 << 16, 1 << 14
#: Rows (nodes and visitors) of a shard that are cut again by another tree, and how often at most (each cut makes up to LEAVES of one).
SPLIT, CUTS = 1 << 20, 3
SLICE = 2 << 20
PAIRS = 1 << 21


def shingle_hashes(words: list[bytes], n: int, seed: int) -> list[int]:
    """XXH64 of the n-word shingles, repeats included; of all words together if they are fewer."""
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    text, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    hash_ = xxhash.xxh64_intdigest
    return [hash_(text[a : b - 1], seed) for a, b in zip([0, *ends], ends[n - 1 :])]


def simhashes(texts: list[str | None], n: int, seed: int) -> np.ndarray:
    """Fingerprints as signed 64-bit; a bit is set if it is in over half of the hashes; zero without words."""
    out = np.zeros(len(texts), dtype=np.int64)
    for a, b in slices([len(t or "") for t in texts], SLICE):
        hashes, sizes = [], []
        for t in texts[a:b]:
            mine = shingle_hashes(words_of(t), n, seed)
            hashes += mine
            sizes.append(len(mine))
        size = np.array(sizes)
        some = size > 0
        if some.any():
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, (np.cumsum(size) - size)[some], axis=0, dtype=np.int32)
            out[a:b][some] = np.packbits(2 * ones > size[some, None], axis=1).view(">i8")[:, 0]
    return out


def fingerprint(text: Column, n: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a long."""
    return F.pandas_udf(lambda s: pd.Series(simhashes([t if isinstance(t, str) else None for t in s], n, seed)), "long").asNondeterministic()(text)


class Tree:
    """Vantage points with the distance that parts near from far; leaves are numbered."""

    def __init__(self, sample: np.ndarray, depth: int, least: int = 8):
        self.nodes: list[tuple] = []  # (vantage, border, near, far), or (leaf,)
        self.leaves = 0
        self._grow(sample, depth, least)

    def _grow(self, points: np.ndarray, depth: int, least: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if depth > 0 and len(points) >= 2 * least:
            tries = points[:: max(1, len(points) // 5)][:5]
            far = [np.bitwise_count(points ^ v).astype(np.int64) for v in tries]
            k = int(np.argmax([d.std() for d in far]))
            border = int(np.median(far[k]))
            near = far[k] <= border
            if least <= near.sum() <= len(points) - least:
                self.nodes[at] = (tries[k], border, self._grow(points[near], depth - 1, least), self._grow(points[~near], depth - 1, least))
                return at
        self.nodes[at] = (self.leaves,)
        self.leaves += 1
        return at

    def route(self, points: np.ndarray, radius: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (index, leaf, at home) so that of two points within the radius one is in the other's home leaf.

        A point at home goes to its own side; of a pair that a border parts, the near one visits the far side.
        """
        out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), dtype=bool) if home is None else home)]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if len(self.nodes[node]) == 1:
                out.append((at, np.full(len(at), self.nodes[node][0]), home))
                continue
            vantage, border, near, far = self.nodes[node]
            d = np.bitwise_count(points[at] ^ vantage).astype(np.int64)
            inside, reach = d <= border, d > border - radius
            to_near = np.where(home, inside, d <= border + radius)
            todo.append((near, at[to_near], home[to_near]))
            todo.append((far, at[reach], (home & ~inside)[reach]))
        if not out:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def lowest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the pairs (a, b)."""
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def groups(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each point the smallest index in its group: home points are compared with all points."""
    depth = max(0, math.ceil(math.log2(max(1, len(points)) / LEAF)))
    step = max(1, len(points) // max(1, min(len(points), LEAF << min(depth, 6))))
    tree = Tree(points[::step], depth, 32)
    at, leaf, own = tree.route(points, radius, home)
    order = np.argsort(leaf, kind="stable")
    edges = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    labels = np.arange(len(points))
    for k in range(tree.leaves):
        mine = order[edges[k] : edges[k + 1]]
        rows, all_ = at[mine[own[mine]]], at[mine]
        for i in range(0, len(rows), max(1, PAIRS // max(1, len(all_)))):
            part = rows[i : i + max(1, PAIRS // max(1, len(all_)))]
            a, b = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[all_][None, :]) <= radius)
            a, b = part[a], all_[b]
            keep = labels[a] != labels[b]
            if keep.any():
                labels = lowest(labels, a[keep], b[keep])
    return labels


def stars(radius: int):
    """Of a shard: links from each node of a group to the group's first node."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        labels = groups(points, pdf["home"].to_numpy(dtype=bool), radius)
        at = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"u": points[at].view(np.int64), "v": points[labels[at]].view(np.int64)})

    return run


def router(tree, radius: int):
    def run(batches):
        for pdf in batches:
            points = pdf["fp"].to_numpy(dtype=np.int64)
            at, leaf, home = tree.value.route(points.view(np.uint64), radius)
            yield pd.DataFrame({"shard": leaf, "fp": points[at], "home": home})

    return run


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v): rows (node, root) for every linked node but the root itself.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest chain. A root with many nodes is a
    key with many rows on one side of a join, one on the other, which Spark splits.
    """
    # each round: all neighbours above a node, then those below it, are linked to its smallest neighbour
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        edges = materialise(edges, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def planter(depth: int):
    """A tree over the sample of one shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values("fp")["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [pickle.dumps(Tree(points, depth))]})

    return run


def cutter(radius: int):
    """Deals a piece of a shard out to the leaves of the shard's tree."""

    def run(nodes: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(trees):
            return nodes[["shard", "fp", "home"]]
        points = nodes["fp"].to_numpy(dtype=np.int64)
        at, leaf, home = pickle.loads(trees["tree"].iloc[0]).route(points.view(np.uint64), radius, nodes["home"].to_numpy(dtype=bool))
        return pd.DataFrame({"shard": nodes["shard"].iloc[0] * LEAVES + leaf, "fp": points[at], "home": home})

    return run


def cut_again(routed: DataFrame, radius: int, most: int, sampled: int) -> DataFrame:
    """Cuts shards of over `most` rows by trees over samples of their own, each shard up to CUTS times as long as that makes it smaller by a tenth; rows of
    (shard, a, b, fp, home).

    A shard's rows come in pieces of about `most`, each with a copy of the shard's tree, so that no task holds a whole shard. Shards that
    no longer shrink (balls of near fingerprints) are held against themselves piece by piece (a: of the home points, b: of all points).
    """
    kept, was = [], None
    for cut in range(CUTS + 1):
        routed = materialise(routed, "routed")
        sizes = routed.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        before = F.lit(None).cast("long").alias("was")
        sizes = materialise(sizes.withColumn("parent", F.shiftright("shard", LEAVES.bit_length() - 1)).join(was, "parent", "left").drop("parent") if was is not None else sizes.select("*", before), "sizes")
        kept.append(routed.join(sizes.select("shard"), "shard", "left_anti").select("shard", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp", "home"))
        stuck = sizes.filter((10 * F.col("n") > 9 * F.col("was")) | F.lit(cut == CUTS))
        kept.append(in_pieces(routed.join(stuck.select("shard", "n"), "shard"), most))
        sizes = materialise(sizes.join(stuck.select("shard"), "shard", "left_anti"), "sizes")
        largest = sizes.agg(F.max("n")).first()[0]
        if not largest:
            return reduce(DataFrame.union, kept)
        was = sizes.select(F.col("shard").alias("parent"), F.col("n").alias("was"))
        over = routed.join(sizes.select("shard", "n"), "shard")
        u = F.pmod(F.xxhash64("fp", F.lit(largest)), F.lit(1 << 30)) / float(1 << 30)
        some = over.filter("home").filter(u < F.least(F.lit(1.0), F.greatest(F.lit(1.0 / SAMPLE), F.lit(float(LEAF)) / F.col("n")), sampled / F.col("n")))
        trees = some.groupBy("shard").applyInPandas(planter(max(1, math.ceil(math.log2(largest / SHARD)))), "shard long, tree binary")
        pieces = F.ceil(F.col("n") / most).cast("int")
        copies = trees.join(sizes, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        dealt = over.withColumn("piece", F.pmod(F.xxhash64("fp"), pieces).cast("int"))
        routed = dealt.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece")).applyInPandas(cutter(radius), "shard long, fp long, home boolean")


def in_pieces(rows: DataFrame, most: int) -> DataFrame:
    """Rows (shard, fp, home, n) in pieces of which two are about `most`: each piece of home points (a) with each piece of all points (b), as visitors."""
    k = F.ceil(2 * F.col("n") / most).cast("int")
    piece, all_ = F.pmod(F.xxhash64("fp", F.lit(1)), k).cast("int"), F.explode(F.sequence(F.lit(0), k - 1))
    homes = rows.filter("home").select("shard", piece.alias("a"), all_.alias("b"), "fp", "home")
    return homes.union(rows.select("shard", all_.alias("a"), piece.alias("b"), "fp", F.lit(False)).select("shard", "a", "b", "fp", F.lit(False)))


def near_links(nodes: DataFrame, radius: int, sampled: int = MOST_SAMPLED, split: int = SPLIT) -> DataFrame:
    """Stars (u, v) that connect all distinct fingerprints (column fp) within the radius of each other."""
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    sample = []
    if depth:  # a bounded share of the nodes
        some = nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
        sample = [r[0] for r in some.orderBy(F.xxhash64("fp")).limit(sampled).collect()]
    first = Tree(np.array(sample, dtype=np.int64).view(np.uint64), depth)
    routed = nodes.select("fp").mapInPandas(router(spark.sparkContext.broadcast(first), radius), "shard long, fp long, home boolean")
    if n <= split:  # a shard has a fingerprint once at most
        return routed.groupBy("shard").applyInPandas(stars(radius), "u long, v long")
    return cut_again(routed, radius, split, sampled).groupBy("shard", "a", "b").applyInPandas(stars(radius), "u long, v long")


def simhash_components(docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links between
    fingerprints that differ in `radius` bits or fewer.

    Null, empty and blank texts have fingerprint zero and link like any other. Every row gives a row; null ids never
    name a component unless it has no other. An empty table gives no rows; other columns are ignored.
    """
    marked = materialise(docs.select("doc_id", fingerprint(F.col("text"), words, seed).alias("fp")), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(near_links(nodes, radius))
    linked = materialise(found.union(found.select(F.col("root").alias("node"), "root")).distinct().join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select("fp", "least")
    classes = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
