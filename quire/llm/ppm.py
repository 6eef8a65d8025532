"""LM scoring by prediction by partial matching over bytes.

The trie of byte contexts up to `order` bytes is the table of all (context, next byte) grams with their counts.
Its nodes never meet in one place: every block of documents asks for the grams that it holds, the requests are
dealt out by the last three context bytes, and each shard turns its counts into code lengths. Requests go up a tree, FAN to a
node, each node adding up what its children ask for; answers come down the same way, each child getting the values of its own
grams only. So a task holds FAN requests of one shard and what is shipped grows with the corpus, however large the model.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.asking import FAN, add_up, climb, descend, split_tokens, token_shard
from quire.llm.common import LOWER, batched, block_count, materialise, pack, pack_sorted, remainder, unpack, unpack_sorted, unzip, zip_bytes

#: Ends a document and fills the context before its first byte; no UTF-8 text holds it.
END = 255
#: Shards of the grams; a block's request has a row for each, so there aren't more, and a shard's share of the model is as bounded as the model.
SHARDS = 4096
CHUNK = 4 << 20
#: Taken off every count for the escape: of total T over q symbols, escapes have ESCAPE * q / T.
ESCAPE = 0.3

#: Rows of a block: kind docs has the texts, kinds gram and token the requests.
BLOCK = "kind string, node long, shard int, keys binary, counts binary, ids array<string>, held array<boolean>"
MODEL = "kind string, shard int, keys binary, vals binary, tokens long, vocab long"
SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def stream_of(docs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents as one byte array, each after `order` filling bytes: the array, first symbols, number of symbols."""
    fill, parts, sizes = bytes([END]) * order, [], np.empty(len(docs), dtype=np.int64)
    for i, body in enumerate(docs):
        parts += [fill, body, bytes([END])]
        sizes[i] = len(body) + 1
    starts = np.cumsum(sizes + order) - sizes
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts, sizes


def grams_at(data: np.ndarray, first: int, last: int, order: int) -> np.ndarray:
    """For the symbols at first..last-1, the symbol and the `order` bytes before it, packed into an unsigned long."""
    out = data[first - order : last - order].astype(np.uint64)
    for k in range(order - 1, -1, -1):
        out <<= np.uint64(8)
        out |= data[first - k : last - k]
    return out


def symbol_ranges(starts: np.ndarray, sizes: np.ndarray):
    """Runs of whole documents of about CHUNK bytes; a longer document in several runs: (first, last, mask of its symbols)."""
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and starts[j] + sizes[j] - starts[i] <= CHUNK:
            j += 1
        end = starts[j - 1] + sizes[j - 1]
        for a in range(int(starts[i]), int(end), CHUNK):
            b = min(a + CHUNK, int(end))
            mask = None
            if j > i + 1:
                edge = np.zeros(b - a + 1, dtype=np.int8)
                edge[starts[i:j] - a] += 1
                edge[starts[i:j] + sizes[i:j] - a] -= 1
                mask = np.cumsum(edge[:-1]).astype(bool)
            yield a, b, mask
        i = j


def count_grams(docs: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    data, starts, sizes = stream_of(docs, order)
    keys, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    for a, b, mask in symbol_ranges(starts, sizes):
        grams = grams_at(data, a, b, order)
        k, c = np.unique(grams if mask is None else grams[mask], return_counts=True)
        keys, counts = add_up(np.concatenate([keys, k]), np.concatenate([counts, c]))
    return keys, counts


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """By the last three bytes of the context."""
    ctx = (grams >> np.uint64(8)) & np.uint64(0xFFFFFF)
    return ((ctx * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def requests(order: int, shards: int, block_bytes: int):
    """Packs documents in blocks: a row with the texts, and rows with the distinct grams and tokens and their counts in the
    documents to learn from (0 where none), a row for each shard."""

    def run(batches):
        for pdf in batched(batches, block_bytes):
            block, learn = uuid.uuid4().int >> 65, pdf["learn"].to_numpy(dtype=bool)
            docs = [t.encode("utf-8", "replace").translate(LOWER) if isinstance(t, str) else b"" for t in pdf["text"]]
            rows = [("docs", block, 0, zip_bytes(b"".join(docs)), pack(np.array([len(d) for d in docs], dtype="<i8")), list(pdf["doc_id"]), pdf["held_out"].tolist())]
            known, kc = count_grams([d for d, x in zip(docs, learn) if x], order)
            other, oc = count_grams([d for d, x in zip(docs, learn) if not x], order)
            keys, counts = add_up(np.concatenate([known, other]), np.concatenate([kc, np.zeros_like(oc)]))
            tokens = Counter(chain.from_iterable(d.split() for d, x in zip(docs, learn) if x))
            tokens.update(dict.fromkeys(set(chain.from_iterable(d.split() for d, x in zip(docs, learn) if not x)), 0))
            tokens[b"\n"] = int(learn.sum())
            of = shard_of(keys, shards)
            at = np.argsort(of, kind="stable")
            keys, counts, of = keys[at], counts[at], of[at]
            edges = np.searchsorted(of, np.arange(shards + 1))
            for s in np.unique(of):
                a, b = edges[s], edges[s + 1]
                rows.append(("gram", block, int(s), pack_sorted(keys[a:b]), pack(counts[a:b]), None, None))
            names = sorted(tokens)
            of = token_shard(names, shards).astype(np.int64)
            at = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[at], np.arange(shards + 1))
            for s in np.unique(of):
                mine = [names[i] for i in at[edges[s] : edges[s + 1]]]
                rows.append(("token", block, int(s), zip_bytes(b" ".join(mine)), pack(np.array([tokens[t] for t in mine], dtype=np.int64)), None, None))
            yield pd.DataFrame(rows, columns=["kind", "node", "shard", "keys", "counts", "ids", "held"])

    return run


def low_grams(batches):
    """Counts of the last two context bytes and the symbol: 2^24 values at most."""
    for pdf in batches:
        for k, c in zip(pdf["keys"], pdf["counts"]):
            key, n = add_up(unpack_sorted(k) & np.uint64(0xFFFFFF), unpack(c, "<i8"))
            yield pd.DataFrame({"gram": key[n > 0].astype(np.int64), "n": n[n > 0]})


def low_packed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("gram")
    return pd.DataFrame({"keys": [pack_sorted(pdf["gram"].to_numpy().astype(np.uint64))], "counts": [pack(pdf["n"].to_numpy(dtype=np.int64))]})


class Level:
    """Nodes whose contexts have k bytes: grams with counts; for each context the total, the number of symbols, and
    what is left of its parent's total and symbols when its own symbols are excluded."""

    def __init__(self, k: int, grams: np.ndarray, counts: np.ndarray, parent: Level | None):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        self.k, self.mask = k, mask
        self.grams, self.counts = add_up(grams & mask, counts)
        ctx = self.grams >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, dtype=np.int64)
        self.nodes = ctx[first]
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.empty(0, dtype=np.int64)
        self.symbols = np.diff(np.append(first, len(ctx)))
        if parent is not None and len(first):
            i, _ = parent.find(self.grams)
            up, _ = parent.node(self.nodes)
            self.left_total = parent.total[up] - np.add.reduceat(parent.counts[i], first)
            self.left_symbols = parent.symbols[up] - self.symbols
        else:
            self.left_total = self.left_symbols = np.empty(0, dtype=np.int64)

    @staticmethod
    def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return i, table[i] == keys

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.grams, grams & self.mask)

    def node(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._at(self.nodes, contexts & (self.mask >> np.uint64(8)))


def code_lengths(wanted: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram's last byte after the others; levels from order 0 up.

    From the longest context seen: a symbol with count c has (c - ESCAPE) / T, an escape ESCAPE * q / T, where T and q are total count
    and number of the symbols that no longer context excluded. Below order 0 all symbols left are equally likely.
    """
    out = np.zeros(len(wanted))
    open_, prev = np.ones(len(wanted), dtype=bool), np.full(len(wanted), -1, dtype=np.int64)
    for n, level in reversed(list(enumerate(levels))):
        node, seen = level.node(wanted >> np.uint64(8))
        if not len(level.nodes):
            continue
        total, symbols = level.total[node], level.symbols[node]
        if n + 1 < len(levels) and len(levels[n + 1].nodes):
            above, came = levels[n + 1], prev >= 0
            at = np.maximum(prev, 0)
            total, symbols = np.where(came, above.left_total[at], total), np.where(came, above.left_symbols[at], symbols)
        i, found = level.find(wanted)
        hit = open_ & seen & found
        out[hit] += np.log10((level.counts[i[hit]] - ESCAPE) / total[hit])
        miss = open_ & seen & ~found
        pays = miss & (total > 0)
        out[pays] += np.log10(ESCAPE * symbols[pays] / total[pays])
        open_ &= ~hit
        prev = np.where(seen, node, -1)
    rest = 256 - (int(levels[0].symbols[0]) if len(levels[0].nodes) else 0)
    out[open_] -= np.log10(rest)
    return out


def low_levels(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    levels: list[Level] = []
    for k in range(3):
        levels.append(Level(k, grams, counts, levels[-1] if levels else None))
    return levels


def models(order: int, low):
    """Of a shard: code lengths of all requested grams, or corpus counts of all requested tokens."""

    def run(batches):
        for pdf in batches:
            for kind, shard, keys, counts in zip(pdf["kind"], pdf["shard"], pdf["keys"], pdf["counts"]):
                c = unpack(counts, "<i8")
                if kind == "token":
                    row = (kind, int(shard), keys, counts, int(c.sum()), int((c > 0).sum()))
                else:
                    levels, k = low_levels(*low.value), unpack_sorted(keys)
                    for n in range(3, order + 1):
                        levels.append(Level(n, k[c > 0], c[c > 0], levels[-1]))
                    vals = np.concatenate([code_lengths(k[a : a + CHUNK], levels) for a in range(0, len(k), CHUNK)])
                    row = (kind, int(shard), keys, pack(vals.astype("<f4")), 0, 0)
                yield pd.DataFrame([row], columns=["kind", "shard", "keys", "vals", "tokens", "vocab"])

    return run


class Lookup:
    """Values by key in an open hash table over numpy arrays; every key asked for must be there."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.vals = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=vals.dtype)
        owner = np.full(1 << bits, -1, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = owner[slot] < 0
            owner[slot[free]] = left[free]
            lost = owner[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask
        used = owner >= 0
        self.keys[used], self.vals[used] = keys[owner[used]], vals[owner[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        for _ in range(self.mask + 1):
            if not len(left):
                return self.vals[slot]
            slot[left] = (slot[left] + 1) & self.mask
            left = left[self.keys[slot[left]] != keys[left]]
        raise KeyError("a gram without a value")


def scores(order: int, tokens: int, vocab: int):
    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        one = block.iloc[0]
        raw, size = unzip(one["keys"]), unpack(one["counts"], "<i8")
        ends = np.cumsum(size).tolist()
        docs = [raw[b - n : b] for b, n in zip(ends, size.tolist())]
        got = found[found["kind"] == "gram"]
        table = Lookup(np.concatenate([unpack_sorted(k) for k in got["keys"]]), np.concatenate([unpack(v, "<f4") for v in got["vals"]]).astype(np.float64))
        data, starts, sizes = stream_of(docs, order)
        score = np.zeros(len(docs))
        for a, b, mask in symbol_ranges(starts, sizes):
            grams = grams_at(data, a, b, order)
            part = np.zeros(b - a + 1)
            if mask is None:
                part[:-1] = table(grams)
            else:
                part[:-1][mask] = table(grams[mask])
            i, j = np.searchsorted(starts + sizes, a, "right"), np.searchsorted(starts, b)
            score[i:j] += np.add.reduceat(part, np.maximum(starts[i:j] - a, 0))
        counts: dict[bytes, int] = {}
        for _, x in found[found["kind"] == "token"].iterrows():
            counts.update(zip(split_tokens(x["keys"]), unpack(x["vals"], "<i8").tolist()))
        words = [d.split() for d in docs]
        n = np.array([len(w) + 1 for w in words], dtype=np.int64)
        each = np.array(list(map(counts.__getitem__, chain.from_iterable([*w, b"\n"] for w in words))), dtype=np.int64)
        first = np.cumsum(n) - n
        known = np.add.reduceat((each > 0).astype(np.int64), first)
        base = np.add.reduceat(np.log10(each + 1), first) - n * np.log10(tokens + vocab + 1)
        return pd.DataFrame({"doc_id": list(one["ids"]), "held_out": np.asarray(one["held"], dtype=bool), "n_tokens": n, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score})

    return run


def ppm_scores(docs: DataFrame, order: int = 5, modulus: int = 7, held: int = 2, block_bytes: int = 8 << 20, fan: int = FAN) -> DataFrame:
    """Scores every document under a PPM model learnt from those whose crc32(doc_id) mod `modulus` isn't `held`.

    Scored is the whole text with A-Z lower-cased, white space and all, and then one end symbol.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null and empty texts are one
    end token. A null doc_id has no remainder: learnt from, not held out. Repeated rows count as often as they occur.
    An empty table gives no rows; with nothing to learn from every byte has probability 1/256. `order` is 3 to 7;
    `block_bytes` is input characters a block; `fan` requests meet at a time.
    """
    if not 3 <= order <= 7:
        raise ValueError("order must be 3 to 7")
    spark = docs.sparkSession
    shards = min(block_count(docs, block_bytes), SHARDS)
    left = remainder(F.col("doc_id"), modulus)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(left == held, F.lit(False)).alias("held_out"), F.coalesce(left != held, F.lit(True)).alias("learn"))
    blocks = materialise(rows.mapInPandas(requests(order, shards, block_bytes), BLOCK), "blocks", "kind")
    texts, asked = blocks.filter("kind = 'docs'"), blocks.filter("kind <> 'docs'").select("kind", "shard", "node", "keys", "counts")

    top, levels = climb(asked, texts.count(), fan)
    low = top.filter("kind = 'gram'").select("keys", "counts").mapInPandas(low_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = low.groupBy(F.shiftright("gram", 16).alias("part")).applyInPandas(low_packed, "keys binary, counts binary").collect()  # 256 rows of 2^16 grams at most
    found = sorted(((unpack_sorted(r["keys"]), unpack(r["counts"], "<i8")) for r in found), key=lambda x: int(x[0][0]))
    empty = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    table = spark.sparkContext.broadcast(tuple(np.concatenate(x) for x in zip(*[empty, *found])))
    model = materialise(top.mapInPandas(models(order, table), MODEL), "model")
    total = model.agg(F.sum("tokens").alias("n"), F.sum("vocab").alias("v")).first()
    told = model.select("kind", "shard", F.lit(0).cast("long").alias("node"), "keys", "vals")
    told = descend(told, levels)
    scored = texts.select("node", "keys", "counts", "ids", "held").groupBy("node").cogroup(told.groupBy("node")).applyInPandas(scores(order, total["n"] or 0, total["v"] or 0), SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))  # as text on the way: pandas would turn nullable longs into doubles
