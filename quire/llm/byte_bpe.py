"""Byte-level BPE by rank files, in two tiers.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves; for the others a heap over
linked bytes applies the merges in rank order. Both see each distinct pre-token of a block once; ids of texts are
then gathered from those of their pre-tokens, and decoding gathers bytes from ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Index, slices
from quire.llm.pretokens import segment_sums

CARRY = 250_000
SLICE = 1 << 19


class PerfectHash:
    """Minimal perfect hash over distinct byte strings, by hash and displace: keys share buckets of about three, and
    each bucket has a seed that sends its keys to free slots, or the slot itself (as -1 - slot) where it has one key.
    A slot keeps its key, so strangers are told apart."""

    TRIES = 64

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        self.seed = np.zeros(self.buckets, dtype=np.int64)
        self.slots: list[bytes | None] = [None] * self.n
        self.values = np.zeros(self.n, dtype=np.int64)
        h = self.hashes(keys)
        of = (h % np.uint64(self.buckets)).astype(np.int64)
        at = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[at], np.arange(self.buckets + 1))
        free = np.ones(self.n, dtype=bool)
        size = np.diff(edges)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            mine, first = at[edges[b] : edges[b + 1]], 0
            while True:
                tries = np.arange(first, first + self.TRIES, dtype=np.uint64)
                slot = np.sort(self._slot(h[mine], tries[:, None]), axis=1)
                good = free[slot].all(axis=1) & (np.diff(slot, axis=1) > 0).all(axis=1)
                if good.any():
                    break
                first += self.TRIES
            self.seed[b] = first + int(good.argmax())
            free[slot[good.argmax()]] = False
        rest = np.flatnonzero(free)
        alone = np.flatnonzero(size == 1)
        self.seed[alone] = -1 - rest[: len(alone)]
        slot = self.slot(h)
        self.values[slot] = np.arange(self.n)
        for s, k in zip(slot.tolist(), keys):
            self.slots[s] = k

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def _slot(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        x = (h ^ (seed * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        return ((x * np.uint64(0x94D049BB133111EB) >> np.uint64(32)) % np.uint64(max(1, self.n))).astype(np.int64)

    def slot(self, h: np.ndarray) -> np.ndarray:
        seed = self.seed[(h % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, self._slot(h, np.maximum(seed, 0).astype(np.uint64)))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key among those the hash was built from; -1 for others."""
        if not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        slot, held = self.slot(self.hashes(keys)), self.slots
        return np.fromiter((v if held[s] == k else -1 for s, k, v in zip(slot.tolist(), keys, self.values[slot].tolist())), dtype=np.int64, count=len(keys))


class Vocabulary:
    def __init__(self, path: str):
        pairs = [line.split() for line in open(path, "rb") if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = list(self.ranks)
        self.whole = PerfectHash(tokens)
        self.ids = np.array([self.ranks[t] for t in tokens], dtype=np.int64)
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for t, i in self.ranks.items():
            by_id[i] = t
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.length = np.array([len(t) for t in by_id], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def merge(self, word: bytes) -> list[int]:
        """Ids of a byte string: the adjacent pair of lowest rank is merged first, the leftmost of equals, until none is left."""
        get, n = self.ranks.get, len(word)
        part = [word[i : i + 1] for i in range(n)]
        pair = [get(word[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of what starts here and its successor
        after, before = list(range(1, n + 1)), list(range(-1, n))
        bits = n.bit_length()
        low = (1 << bits) - 1
        heap = [(r << bits) + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x & low
            if pair[i] != x >> bits:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i] = a = part[i] + part[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                if (r := get(a + part[k], -1)) >= 0:
                    pair[i] = r
                    heappush(heap, (r << bits) + i)
            if (k := before[i]) >= 0:
                pair[k] = r = get(part[k] + a, -1)
                if r >= 0:
                    heappush(heap, (r << bits) + k)
        out, i = [], 0
        while i < n:
            out.append(get(part[i]))
            i = after[i]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after the other, and how many each has."""
        hit = self.whole.find(words)
        sizes = np.ones(len(words), dtype=np.int64)
        lists = {i: self.merge(words[i]) for i in np.flatnonzero(hit < 0).tolist()}
        for i, x in lists.items():
            sizes[i] = len(x)
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        at = np.cumsum(sizes) - sizes
        known = hit >= 0
        out[at[known]] = self.ids[hit[known]]
        if lists:
            out[ranges(at[~known], sizes[~known])] = np.fromiter((y for x in lists.values() for y in x), dtype=np.uint32)
        return out, sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        return self.bytes[ranges(self.start[ids], self.length[ids])]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... of each range in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def coder(path: str, pattern: str, with_ids: bool):
    """Frames of half a million characters leave one by one, so that a task holds the ids of no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, split = load_vocabulary(path), regex.compile(pattern).findall
        index = Index()
        ids, sizes = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        starts = sizes
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for a, b in slices([len(t) for t in texts], SLICE):
                if len(index) > CARRY:
                    index, ids, sizes = Index(), ids[:0], sizes[:0]
                known, flat, counts, rows = len(index), [], [], []
                for t in texts[a:b]:
                    words = split(t)
                    flat += map(index.__getitem__, words)
                    counts.append(len(words))
                if len(index) > known:
                    more = vocabulary.encode([w.encode("utf-8", "replace") for w in list(index)[known:]])
                    ids, sizes = np.concatenate([ids, more[0]]), np.concatenate([sizes, more[1]])
                    starts = np.cumsum(sizes) - sizes
                flat, counts = np.array(flat, dtype=np.int64), np.array(counts, dtype=np.int64)
                each = segment_sums(sizes[flat], counts)
                at = np.cumsum(counts) - counts
                for k, n in enumerate(each.tolist()):
                    mine = flat[at[k] : at[k] + counts[k]]
                    own = ids[ranges(starts[mine], sizes[mine])]
                    row = (n, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(vocabulary.decode(own).tobytes()).hexdigest())
                    rows.append((*row, own.astype(np.int32)) if with_ids else row)  # arrays: a list would hold an object for each id
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
                out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].to_numpy())
                yield out

    return run


def document_codes(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes; the ids too if asked for.

    Null and empty texts have no ids. Every row gives a row, whatever its id; an empty table gives none; other columns
    are ignored, whatever their names.
    """
    kind = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text on the way: pandas would turn nullable longs into doubles
    coded = rows.mapInPandas(coder(path, pattern, with_ids), kind)
    return coded.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
