"""Near-duplicates by exact Jaccard similarity of shingle sets, with SimHash in front of it.

Equal sets are one node. Fingerprints that differ in few bits come first: the vantage-point shards of vptree find them, the sets confirm them.
A similarity of 0.8 leaves up to some 20 of 64 bits different, too wide for triangle bounds to prune anything, so the other pairs come from
the shingles. Two sets as similar as wanted share one of their first shingles, if these are put in one order for
all (rare ones first), and as many are taken as a partner may lack: so each of these shingles is a block that holds all pairs to
look at. Most shingles stand in one set only: they are packed, sorted and dealt to shards, which give back those of several sets. Of blocks of
the same nodes, as the shingles of a shared passage make them, one is enough. Lengths, places in the order and
parities over the sets leave few pairs, which are confirmed by the sets themselves. Links to one
node of a block come before all other pairs, so that a large group of copies isn't compared each with each.
Tables that are no longer read are deleted at once, and the rows of blocks, which are dealt out in each round, are narrow.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, materialise, pack_bytes, shuffle_partitions, slices, unpack_bytes, words_of
from quire.llm.vptree import components, near_links, shingle_hashes

#: Bits up to which vantage-point shards look for fingerprints.
NEAR = 3
#: Documents (expected number) that tell which shingles are common: those that so many of them have, MOST_COMMON at most. They
#: decide the order of shingles only, not the result.
SAMPLED, LEAST_SEEN, MOST_COMMON = 10_000, 3, 1 << 18
#: Blocks get another first node while a round's links are this share of the nodes.
GO_ON = 0.01
#: Pairs to confirm, and bytes of the texts they are held against, that are broadcast.
BROADCAST_NODES, BROADCAST_BYTES = 300_000, 16 << 20
#: Longs of parities over a set. The more, the larger sets they tell apart: of two sets of n shingles some 2n/9 may stand in one alone.
PARITIES = 16
ODD = [f"odd{k}" for k in range(PARITIES)]
#: Copies of nodes, by row, that are broadcast.
BROADCAST_ROWS = 1_000_000
#: First shingles that a task packs at once, and of a shard (expected number).
PACKED, SHARD = 1 << 19, 1 << 19
#: Characters of the texts whose sets a task holds at once.
SLICE = 1 << 20


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(words_of(text), words, seed), dtype=np.uint64))


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: each shingle counts once, however often the text repeats it."""
    if not len(s):
        return 0
    ones = np.unpackbits(s.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s)).view(">i8")[0])


def parities(s: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    """Bit b of long k says whether an odd number of the set's shingles fall on it. Each shingle that one of two sets has alone turns one bit, so
    the bits in which two parities differ are no more than the shingles in which the sets do."""
    ones = np.bincount((s % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs)
    return np.packbits((ones & 1).astype(np.uint8), bitorder="little").view("<i8")


def wide_parities(s: np.ndarray) -> np.ndarray:
    """Of a set with more shingles than PARITIES has bits, parities of as many bits (or up to twice as many); else none."""
    return parities(s, 1 << (len(s) - 1).bit_length() - 6) if len(s) > 64 * PARITIES else np.empty(0, dtype=np.int64)


def parity(s: np.ndarray) -> int:
    return int(parities(s, 1)[0])


def first_shingles(s: np.ndarray, common: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a set that is similar has one among its own."""
    if not len(s):
        return s
    n = np.zeros(len(s), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        n = np.where(common[at] == s, seen[at], 0)
    return s[np.lexsort((s, n))][: len(s) - -(-percent * len(s) // 100) + 1]


def parts(batches):
    """The frames in parts of about SLICE characters of text."""
    for pdf in batches:
        for a, b in slices([len(t) if isinstance(t, str) else 0 for t in pdf["text"]], SLICE):
            yield pdf.iloc[a:b]


def marker(known, words: int, percent: int, seed: int):
    """Of each text the name, size, fingerprint, parities and first shingles of its set."""

    def run(batches):
        common, seen = known.value
        for pdf in parts(batches):
            sets = [shingle_set(t, words, seed) for t in pdf["text"]]
            firsts = [first_shingles(s, common, seen, percent).view(np.int64) for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "node": [node_of(s) for s in sets], "n": [len(s) for s in sets], "fp": [set_fingerprint(s) for s in sets]} | dict(zip(ODD, np.array([parities(s) for s in sets]).T)) | {"wide": [wide_parities(s) for s in sets], "firsts": firsts})

    return run


def common_shingles(docs: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several documents of a sample, sorted, and in how many."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text").distinct()

    def run(batches):
        for pdf in parts(batches):
            yield pd.DataFrame({"shingle": np.concatenate([np.empty(0, dtype=np.uint64), *[shingle_set(t, words, seed) for t in pdf["text"]]]).view(np.int64)})

    found = some.mapInPandas(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_SEEN)
    got = found.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toPandas()
    shingles = got["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], got["n"].to_numpy(dtype=np.int64)[order]


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are as similar as wanted.

    The texts of the nodes v, of which there are few as many u are held against one, are brought to those of the nodes u: texts, since sets of
    hashes take several times as much room and don't compress.
    """
    pairs = materialise(pairs, "pairs")
    small = lambda df, rows: F.broadcast(df) if df.count() <= rows else df
    hubs = materialise(pairs.select(F.col("v").alias("node")).distinct().join(nodes, "node").select(F.col("node").alias("v"), F.col("first").alias("doc_id")), "hubs")
    asked = materialise(pairs.join(nodes, F.col("u") == F.col("node")).select(F.col("first").alias("doc_id"), "u", "v"), "asked")

    def compared(batches):
        last, hub = (None, None, None), (None, None, None)  # text, set, node
        known = lambda t, held: held if held[1] is not None and t == held[0] else (t, s := shingle_set(t, words, seed), node_of(s))
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for i, (t, u, other, v) in enumerate(zip(pdf["text"], pdf["u"], pdf["other"], pdf["v"])):
                last, hub = known(t, last), known(other, hub)
                # a doc_id may repeat with another text
                if last[2] == u and hub[2] == v:
                    k = len(np.intersect1d(last[1], hub[1], assume_unique=True))
                    keep[i] = 100 * k >= percent * (len(last[1]) + len(hub[1]) - k)
            yield pdf.loc[keep, ["u", "v"]]

    # rows that repeat are compared once; the keys tell whether there are any
    ids = docs.select("doc_id").groupBy("doc_id").count().agg(F.max("count")).first()[0] or 1
    once = lambda df: df.distinct() if ids > 1 else df
    texts = docs.select("doc_id", "text")
    others = once(texts.join(small(hubs, BROADCAST_NODES), "doc_id").select("v", F.col("text").alias("other")))
    size = others.agg(F.sum(F.octet_length("other"))).first()[0] or 0
    rows = once(texts.join(small(asked, BROADCAST_NODES), "doc_id").select("u", "v", "text")).join(F.broadcast(others) if size <= BROADCAST_BYTES else others, "v")
    out = materialise(rows.select("u", "v", "text", "other").mapInPandas(compared, "u long, v long").distinct(), "confirmed")
    discard(pairs, hubs, asked)
    return out


def packer(shards: int):
    """First shingles in order, and beside each its set's row and its place there, packed in a row for each shard."""

    def packed(base, keys, rows, at):
        order = np.argsort(keys)
        keys, rows, at = keys[order], rows[order], at[order]
        edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                yield k, pack_bytes(np.diff(keys[a:b], prepend=np.uint64(0))), pack_bytes((rows[a:b] - base).astype("<u4")), pack_bytes(at[a:b].astype("<u4"))

    def emptied(held):
        base = min(int(rows.min()) for _, rows, _ in held)
        out = pd.DataFrame(packed(base, *map(np.concatenate, zip(*held))), columns=["shard", "keys", "rows", "places"])
        held.clear()
        return out.assign(base=base)

    def run(batches):
        held, size, part = [], 0, None
        for pdf in batches:
            row = pdf["row"].to_numpy(dtype=np.int64)
            # ids of rows have the number of the partition that made them above 33 bits of their own
            for a, b in runs(row >> 31):
                firsts = list(pdf["firsts"].iloc[a:b])
                n = np.array([len(x) for x in firsts], dtype=np.int64)
                if not n.sum():
                    continue
                if held and (part != row[a] >> 31 or size + n.sum() > PACKED):
                    yield emptied(held)
                    size = 0
                held.append((np.concatenate(firsts).astype(np.int64).view(np.uint64), np.repeat(row[a:b], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
                size, part = size + n.sum(), row[a] >> 31
        if held:
            yield emptied(held)

    return run


def runs(x: np.ndarray):
    """Index ranges of equal neighbours."""
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1), len(x)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def mixed(rows: np.ndarray, by: int) -> np.ndarray:
    """Hashes of numbers (the finalizer of SplitMix64)."""
    z = rows.view(np.uint64) + np.uint64(by)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def shared_shingles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a shard the shingles of several sets; with the first row of each, the number, two hashes of all its rows, and the sum of its places."""
    keys = np.concatenate([np.cumsum(unpack_bytes(x, "<u8"), dtype=np.uint64) for x in pdf["keys"]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    some = ~new | ~np.append(new[1:], True)
    keys, order, start = keys[some], order[some], np.flatnonzero(new[some])
    rows = np.concatenate([unpack_bytes(x, "<u4").astype(np.int64) + base for x, base in zip(pdf["rows"], pdf["base"])])[order]
    at = np.concatenate([unpack_bytes(x, "<u4") for x in pdf["places"]])[order].astype(np.int64)
    out = pd.DataFrame({"shingle": keys.view(np.int64), "row": rows, "at": at.astype(np.int32)})
    if len(start):
        sums = {"c": np.diff(start, append=len(keys)), "g": np.bitwise_xor.reduceat(mixed(rows, 1), start).view(np.int64), "h": np.bitwise_xor.reduceat(mixed(rows, 0x9E3779B97F4A7C15), start).view(np.int64), "places": np.add.reduceat(at, start)}
    else:
        sums = dict.fromkeys(("c", "g", "h", "places"), np.empty(0, dtype=np.int64))
    for k, x in sums.items():
        out[k] = 0
        out.loc[start, k] = x
    return out


def different_blocks(sets: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """Rows (node, shingle, at, n, root) of the first shingles that several nodes have, one shingle for each set of nodes: the first in the order of all.

    Two nodes are held against each other at the first shingle they share, and that of a block of the same nodes as an earlier one isn't the first
    of any two. An earlier shingle is earlier in each of its sets, so its places have the smaller sum.
    """
    rows = one.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).first()[0] or 0
    shards = max(2 * shuffle_partitions(sets.sparkSession), math.ceil(rows / SHARD))
    dealt = sets.select("row", "firsts").mapInPandas(packer(shards), "shard int, keys binary, rows binary, places binary, base long")
    shared = materialise(dealt.groupBy("shard").applyInPandas(shared_shingles, "shingle long, row long, at int, c long, g long, h long, places long"), "shared")
    firsts = materialise(shared.filter("c > 0").groupBy("c", "g", "h").agg(F.min_by("shingle", "places").alias("shingle")).select("shingle"), "firsts")
    kept = shared.select("row", "shingle", "at").join(F.broadcast(firsts) if firsts.count() <= BROADCAST_NODES else firsts, "shingle")
    out = materialise(kept.join(one.select("row", "node", "n"), "row").select("node", "shingle", "at", "n", F.col("node").alias("root")), "blocks")
    discard(shared, firsts)
    return out


def still_mixed(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """The blocks with the roots of their nodes' components as they are now, without those that lie in one component."""
    rows = materialise(blocks.drop("root").join(named, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    several = rows.groupBy("shingle").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("shingle")
    out = materialise(rows.join(several, "shingle"), "blocks")
    discard(blocks, rows)
    return out


def turned(x: str, y: str) -> Column:
    """Bits in which two parities differ."""
    return reduce(Column.__add__, [F.bit_count(F.col(x + k).bitwiseXOR(F.col(y + k))) for k in ODD])


def differ_most(m: Column, n: Column, percent: int) -> Column:
    """Shingles that one of two similar sets may have alone: they share so many, and differ in the others."""
    return m + n - 2 * F.ceil(percent * (m + n) / (100 + percent))


def not_apart(pairs: DataFrame, one: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes of similar lengths that their parities don't tell apart."""
    c, few = F.col, pairs.count() <= BROADCAST_NODES
    small = lambda df: F.broadcast(df) if few else df
    xor = lambda a, b: a.bitwiseXOR(b)
    of = lambda x: one.select(c("node").alias(x), *[c(k).alias(f"{x}_{k}") for k in ("n", *ODD, "wide")])
    pairs = pairs.select(c("u").alias("x"), c("v").alias("y"))
    both = of("x").join(small(pairs), "x").join(of("y").join(small(pairs.select("y").distinct()), "y", "left_semi"), "y")
    # of two sizes the larger is twice the smaller: shingles fall on the halves as they do on the smaller
    k = F.least(F.size("x_wide"), F.size("y_wide"))
    folded = lambda x: F.when(F.size(x) <= k, x).otherwise(F.zip_with(F.slice(x, 1, k), F.slice(x, k + 1, k), xor))
    wide = F.aggregate(F.zip_with(folded(c("x_wide")), folded(c("y_wide")), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda a, b: a + b)
    most = differ_most(c("x_n"), c("y_n"), percent)
    return both.filter((turned("x_", "y_") <= most) & F.when(k > 0, wide <= most).otherwise(True)).select(c("x").alias("u"), c("y").alias("v"))


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, seed: int = 42) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links between documents whose sets of `words`-word
    shingles have a Jaccard similarity of `percent` or more.

    Null, empty and blank texts have the same empty set. Every row gives a row; an empty table gives none; other columns are ignored.
    """
    spark, c = docs.sparkSession, F.col
    known = spark.sparkContext.broadcast(common_shingles(docs, words, seed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # the node, and what else is known of a set, comes from the first row that has it
    marks = f"doc_id {kind}, node long, n int, fp long, {', '.join(f'{x} long' for x in ODD)}, wide array<long>, firsts array<long>"
    sets = materialise(docs.select("doc_id", "text").mapInPandas(marker(known, words, percent, seed), marks).withColumn("row", F.monotonically_increasing_id()), "sets")
    marked = materialise(sets.select("doc_id", "node"), "ids")
    nodes = materialise(sets.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")), "nodes")
    copies = materialise(sets.select("row").join(nodes.select("row"), "row", "left_anti"), "copies")
    own = sets.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti")
    one = materialise(own.select("row", "node", "n", "fp", *ODD, "wide"), "one")
    left, nodes, total = different_blocks(own, one, percent), nodes.select("node", "first"), nodes.count()
    discard(sets, copies)

    def alike(x: str, y: str):
        of = lambda k: (c(f"{x}{k}"), c(f"{y}{k}"))
        (m, n), (i, j) = of("n"), of("at")
        # at the first shingle that two sets share, what follows it in both is enough for the similarity
        enough = (100 + percent) * F.least(m - i, n - j) >= percent * (m + n)
        return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & enough

    by_fp = materialise(one.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = near_links(by_fp.select("fp"), NEAR)
    near = near.join(by_fp.select(c("fp").alias("u"), c("node").alias("x")), "u").join(by_fp.select(c("fp").alias("v"), c("node").alias("y")), "v")
    same = one.select("fp", c("node").alias("u")).join(by_fp, "fp").filter("u <> node")
    links = confirmed(near.select(c("x").alias("u"), c("y").alias("v")).union(same.select("u", c("node").alias("v"))), docs, nodes, words, percent, seed)
    while True:
        before = links.count()
        joined = components(links)
        named = joined.union(joined.select(c("root").alias("node"), "root")).distinct()
        # what has linked so far isn't looked at again; blocks of one component are done
        left = still_mixed(left, named)
        # each round has other nodes that all of a block are held against
        start = F.first(F.struct("node", "n", "at", "root")).over(Window.partitionBy("shingle").orderBy(F.xxhash64("node", F.lit(before)), "node").rowsBetween(Window.unboundedPreceding, 0))
        stars = left.withColumn("start", start).filter("root <> start.root").filter(alike("", "start."))
        candidates = materialise(stars.select(F.col("node").alias("u"), F.col("start.node").alias("v")).distinct(), "candidates")
        found = confirmed(not_apart(candidates, one, percent), docs, nodes, words, percent, seed)
        discard(candidates)
        links, new = links.union(found), found.count()
        if new <= GO_ON * total:
            break
    joined = components(links)
    named = joined.union(joined.select(c("root").alias("node"), "root")).distinct()
    left = still_mixed(left, named)
    full = left.join(one.select("node", *ODD), "node")
    x, y = full.alias("x"), full.alias("y")
    close = turned("x.", "y.") <= differ_most(c("x.n"), c("y.n"), percent)
    pairs = x.join(y, (c("x.shingle") == c("y.shingle")) & (c("x.node") > c("y.node")) & (c("x.root") != c("y.root")) & alike("x.", "y.") & close)
    candidates = materialise(pairs.select(c("x.node").alias("u"), c("y.node").alias("v")).distinct(), "candidates")
    discard(left)
    more = confirmed(not_apart(candidates, one, percent), docs, nodes, words, percent, seed)
    discard(candidates, one)
    found = components(links.union(more))
    whole = materialise(found.union(found.select(c("root").alias("node"), "root")).distinct().join(nodes, "node"), "linked")
    least = whole.groupBy("root").agg(F.min("first").alias("least"))
    classes = nodes.join(whole.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    return marked.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")
