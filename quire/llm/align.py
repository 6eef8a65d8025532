"""Alignment of two tokenizers over the same texts, by products of sparse incidence matrices.

Tokens of either side are rows of a matrix with a column for every byte of the text and ones where the token lies. The product A·Bᵀ, built row
by row, has the bytes that two tokens share: its entries are the overlap links. Byte offsets at which tokens of both sides end cut a text into
groups; with a column for every group instead of every byte the product gives the links of tokens in one group. Links of tokens that
end together are the overlap links whose rows end at the same byte.

Both tokenizers encode a unit (see units) on its own, so each distinct unit is aligned once while a table of them lasts. Documents come
in blocks; a block asks shards (by the B id) for the corpus-wide counts of its id pairs, and sums them for its documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.asking import add_up, climb
from quire.llm.byte_bpe import ranges
from quire.llm.common import Index, batched, block_count, materialise, pack, pack_sorted, unpack, unpack_sorted
from quire.llm.pretokens import segment_sums
from quire.llm.replies import descend_longs
from quire.llm.units import byte_letters, flat_ids, in_batches, json_ids, load_tokenizer, numbers

#: Characters of a block, shards of the id pairs, units and characters after which the table of a worker starts anew.
SLICE, SHARDS, CARRY, CARRY_CHARS = 4 << 20, 4096, 200_000, 16 << 20
KINDS = ("overlap", "group", "end")
#: Rows of a block: kind docs has its documents, kind gram the id pairs that it asks a shard for.
BLOCK = "kind string, node long, shard int, keys binary, counts binary, units binary, places binary, ids array<string>, sums binary, digests array<string>"
RESULT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Csr:
    """A sparse matrix of ones: row i has the columns cols[ptr[i]:ptr[i + 1]]."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, n_cols: int):
        self.ptr, self.cols, self.n_cols = ptr, cols, n_cols

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def transpose(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.n_cols))]), self.rows[order], len(self.ptr) - 1)

    def times(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of each entry of the product: a row gathers the rows of `other` that its columns name and adds up
        what falls on one column (Gustavson)."""
        sizes = np.diff(other.ptr)[self.cols]
        key = np.repeat(self.rows, sizes) * other.n_cols + other.cols[ranges(other.ptr[self.cols], sizes)]
        if len(key) and (key[1:] < key[:-1]).any():
            key = np.sort(key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
        row, col = np.divmod(key[first], other.n_cols)
        return row, col, np.diff(np.append(first, len(key)))


def byte_incidence(sizes: np.ndarray) -> Csr:
    """Tokens that lie one after the other, by the bytes that they cover."""
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    return Csr(ptr, np.arange(ptr[-1]), int(ptr[-1]))


def group_numbers(a_ends: np.ndarray, b_ends: np.ndarray, n_bytes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each token of either side, from the offsets at which tokens end, and how many there are."""
    at_a, at_b = np.zeros(n_bytes + 1, dtype=bool), np.zeros(n_bytes + 1, dtype=bool)
    at_a[a_ends], at_b[b_ends] = True, True
    both = at_a & at_b
    before = np.cumsum(both) - both
    return before[a_ends], before[b_ends], int(both.sum())


def group_incidence(of: np.ndarray, groups: int) -> Csr:
    return Csr(np.arange(len(of) + 1), of, groups)


def token_links(a_sizes: np.ndarray, b_sizes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A token, B token and value of each link of two tilings of the same bytes: shared bytes for `overlap` and `end`, one for `group`."""
    if kind == "group":
        a_of, b_of, n = group_numbers(np.cumsum(a_sizes), np.cumsum(b_sizes), int(a_sizes.sum()))
        return group_incidence(a_of, n).times(group_incidence(b_of, n).transpose())
    a, b = byte_incidence(a_sizes), byte_incidence(b_sizes)
    i, j, shared = a.times(b.transpose())
    if kind == "end":
        same = a.ptr[i + 1] == b.ptr[j + 1]
        i, j, shared = i[same], j[same], shared[same]
    return i, j, shared


class Bytes:
    """The bytes of every token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.start[ids], self.size[ids])]


def json_bytes(path: str) -> Bytes:
    t, letters = load_tokenizer(path, True), byte_letters()
    names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return Bytes([bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in names])


class Pieces:
    """A sentencepiece model: ids of units, whose first space the library adds itself, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        each = range(self.model.get_piece_size())
        self.bytes = Bytes([bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in each])
        # the library adds no space to an empty text, so what it makes of a text's last space is seen after a letter
        self.last_space = self.model.encode("a ")[len(self.model.encode("a")) :]

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        def batch(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return flat_ids([self.last_space if u == " " else ids for u, ids in zip(some, self.model.encode([u[1:] for u in some], num_threads=1))])

        return in_batches(batch)(units)


def same_bytes(joined: np.ndarray, sizes: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray) -> np.ndarray:
    """For each unit whether the bytes of its tokens are its own."""
    fine = sizes == raw_sizes
    a = joined[ranges((np.cumsum(sizes) - sizes)[fine], sizes[fine])]
    b = raw[ranges((np.cumsum(raw_sizes) - raw_sizes)[fine], sizes[fine])]
    wrong = segment_sums((a != b).astype(np.int64), sizes[fine])
    out = fine.copy()
    out[fine] = wrong == 0
    return out


class Aligner:
    """What is known of each distinct unit: sums (tokens of either side, groups, links), whether its bytes agree, its links as
    pairs of ids, and its groups as text."""

    def __init__(self, a_path: str, b_path: str, kind: str):
        self.kind = kind
        self.encode_a, self.a_bytes = json_ids(a_path, True), json_bytes(a_path)
        self.encode_b = Pieces(b_path)
        self.b_bytes = self.encode_b.bytes
        self.clear()

    def clear(self) -> None:
        self.index, self.chars, self.texts = Index(), 0, []
        self.sums, self.fine = np.empty((0, 4), dtype=np.int64), np.empty(0, dtype=bool)
        self.pairs, self.n_pairs = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, one after the other, and how many each has; new units are aligned."""
        if len(self.index) > CARRY or self.chars > CARRY_CHARS:
            self.clear()
        flat, sizes = numbers(texts, self.index)
        if len(self.index) > len(self.fine):
            self.extend(list(self.index)[len(self.fine) :])
        return flat, sizes

    def extend(self, units: list[str]) -> None:
        self.chars += sum(map(len, units))
        coded = [u.encode("utf-8", "replace") for u in units]
        raw, raw_sizes = np.frombuffer(b"".join(coded), dtype=np.uint8), np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        a, n_a = self.encode_a(units)
        b, n_b = self.encode_b(units)
        a_size, b_size = self.a_bytes.size[a], self.b_bytes.size[b]
        fine = same_bytes(self.a_bytes.joined(a), segment_sums(a_size, n_a), raw, raw_sizes) & same_bytes(self.b_bytes.joined(b), segment_sums(b_size, n_b), raw, raw_sizes)
        a, a_size, n_a = a[np.repeat(fine, n_a)], a_size[np.repeat(fine, n_a)], np.where(fine, n_a, 0)
        b, b_size, n_b = b[np.repeat(fine, n_b)], b_size[np.repeat(fine, n_b)], np.where(fine, n_b, 0)
        i, j, _ = token_links(a_size, b_size, self.kind)  # a unit ends for both sides, so no link leaves it
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        links = np.bincount(unit_a[i], minlength=len(units))
        a_of, b_of, groups = group_numbers(np.cumsum(a_size), np.cumsum(b_size), int(a_size.sum()))
        first = np.zeros(groups, dtype=np.int64)
        first[a_of] = unit_a
        self.texts += written(a, a_of, unit_a, b, b_of, unit_b, len(units))
        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, np.bincount(first, minlength=len(units)), links], axis=1)])
        self.fine = np.concatenate([self.fine, fine])
        self.pairs = np.concatenate([self.pairs, b[j].astype(np.uint64) << np.uint64(32) | a[i].astype(np.uint64)])
        self.n_pairs = np.concatenate([self.n_pairs, links])


def written(a: np.ndarray, a_of: np.ndarray, unit_a: np.ndarray, b: np.ndarray, b_of: np.ndarray, unit_b: np.ndarray, units: int) -> list[str]:
    """The groups of each unit as `a1,a2|b1;`, one after the other."""
    order = np.argsort(np.concatenate([2 * a_of, 2 * b_of + 1]), kind="stable")
    ids, key, unit = np.concatenate([a, b])[order], np.concatenate([2 * a_of, 2 * b_of + 1])[order], np.concatenate([unit_a, unit_b])[order]
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.empty(0, dtype=bool)
    mark = np.where(last, 1 + key % 2, 0).tolist()
    parts = [f"{x}{',|;'[m]}" for x, m in zip(ids.tolist(), mark)]
    ends = np.cumsum(np.bincount(unit, minlength=units)).tolist()
    return ["".join(parts[x:y]) for x, y in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def load_aligner(a_path: str, b_path: str, kind: str) -> Aligner:
    return Aligner(a_path, b_path, kind)


def distinct_counts(groups: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) in one sorted key, and how often each occurs."""
    key, times = np.unique(groups * max(1, width) + values, return_counts=True)
    return key.astype(np.uint64), times


def aligned(a_path: str, b_path: str, kind: str, shards: int):
    """Packs documents in blocks: a row with what is known of them, their units and the units' id pairs, and a row for each shard
    with the block's id pairs and their counts. Pairs are numbered in the order of the shards and, in one, of their keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = load_aligner(a_path, b_path, kind)
        for pdf in batched(batches, SLICE):
            texts = [" " + t if isinstance(t, str) and t else "" for t in pdf["text"]]
            flat, n_units = aligner.number(texts)
            whole = (segment_sums((~aligner.fine[flat]).astype(np.int64), n_units) == 0) & (n_units > 0)
            digests = []
            names, at = aligner.texts, np.cumsum(n_units) - n_units
            for k, n, ok in zip(at.tolist(), n_units.tolist(), whole.tolist()):
                digests.append(hashlib.sha256("".join([names[u] for u in flat[k : k + n].tolist()])[:-1].encode()).hexdigest() if ok else "")
            flat, n_units = flat[np.repeat(whole, n_units)], np.where(whole, n_units, 0)
            sums = np.stack([segment_sums(aligner.sums[flat, c], n_units) for c in range(4)], axis=1)
            mine, place = np.unique(flat, return_inverse=True)
            freq, times = distinct_counts(np.repeat(np.arange(len(texts)), n_units), place, len(mine))
            starts, sizes = np.cumsum(aligner.n_pairs) - aligner.n_pairs, aligner.n_pairs[mine]
            pairs, counts = aligner.pairs[ranges(starts[mine], sizes)], np.repeat(np.bincount(place, minlength=len(mine)), sizes)
            keys, total = add_up(pairs, counts)
            shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            where = np.empty(len(keys), dtype=np.int64)
            where[order] = np.arange(len(keys))
            block = uuid.uuid4().int >> 65
            rows = [("docs", block, len(mine), pack_sorted(freq), pack(times.astype("<i4")), pack(sizes.astype("<i4")), pack(where[np.searchsorted(keys, pairs)].astype("<i4")), list(pdf["doc_id"]), pack(sums), digests)]
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.unique(shard):
                own = order[edges[s] : edges[s + 1]]
                rows.append(("gram", block, int(s), pack_sorted(keys[own]), pack(total[own].astype("<i8")), None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["kind", "node", "shard", "keys", "counts", "units", "places", "ids", "sums", "digests"])

    return run


def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a shard: twice the count of each id pair, and one more where no other pair of its B id has a higher count."""
    for pdf in batches:
        for shard, keys, counts in zip(pdf["shard"], pdf["keys"], pdf["counts"]):
            k, n = unpack_sorted(keys), unpack(counts, "<i8")
            b = k >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
            yield pd.DataFrame([("gram", int(shard), 0, keys, pack(2 * n + (n == most)))], columns=["kind", "shard", "node", "keys", "vals"])


def summed(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Joins a block's links to the counts of their id pairs: by unit, then by document."""
    one = block.iloc[0]
    vals = np.concatenate([np.empty(0, dtype=np.int64), *[unpack(v, "<i8") for v in told.sort_values("shard")["vals"]]])
    sums = unpack(one["sums"], "<i8").reshape(-1, 4)
    more = np.zeros((len(sums), 2), dtype=np.int64)
    if len(vals):
        sizes, linked = unpack(one["units"], "<i4").astype(np.int64), vals[unpack(one["places"], "<i4")]
        doc, unit = np.divmod(unpack_sorted(one["keys"]).astype(np.int64), int(one["shard"]))
        times, first = unpack(one["counts"], "<i4").astype(np.int64), np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for c, v in enumerate((linked & 1, linked >> 1)):
            more[doc[first], c] = np.add.reduceat(times * segment_sums(v, sizes)[unit], first)
    out = pd.DataFrame(np.concatenate([sums, more], axis=1), columns=["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])
    return out.assign(doc_id=list(one["ids"]), groups_sha256=list(one["digests"]))[["doc_id", *out.columns, "groups_sha256"]]


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, kind: str = "end") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of `docs`.

    A is a byte-level .json tokenizer that gets each text after a space, B a .model of sentencepiece, which adds that space. Links are of
    one `kind` (see token_links). An id pair's count is the number of links that hold it in all texts; n_best has the links of a document whose count is the
    highest of their B id, count_sum the sum of all their counts. Null and empty texts, and those whose tokens don't give their bytes
    back, have no tokens: zeros and ''. Repeated rows and null ids give a row each and count as often as they occur; an empty
    table gives none; other columns are ignored, whatever their names.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    shards = min(block_count(docs, SLICE), SHARDS)
    blocks = materialise(rows.mapInPandas(aligned(a_path, b_path, kind, shards), BLOCK), "blocks", "kind")
    texts, asked = blocks.filter("kind = 'docs'"), blocks.filter("kind = 'gram'").select("kind", "shard", "node", "keys", "counts")
    distinct, levels = climb(asked, texts.count())
    told = descend_longs(materialise(distinct.mapInPandas(judged, "kind string, shard int, node long, keys binary, vals binary"), "counts"), levels).select("node", "shard", "vals")
    done = texts.select("node", "shard", "keys", "counts", "units", "places", "ids", "sums", "digests").groupBy("node").cogroup(told.groupBy("node")).applyInPandas(summed, RESULT)
    return done.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def align_texts(docs: DataFrame, a_path: str, b_path: str, kind: str = "overlap") -> DataFrame:
    """doc_id, links (a_token, b_token: places from 0; a_id, b_id; shared: see token_links) of every row of `docs`.

    Rows, ids and texts are treated as in alignment_digests; a text without tokens has no links.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_a, encode_b, a_bytes = json_ids(a_path, True), Pieces(b_path), json_bytes(a_path)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                text = " " + t if isinstance(t, str) and t else ""
                raw = text.encode("utf-8", "replace")
                a, b = (f([text] if text else [])[0] for f in (encode_a, encode_b))
                links: list = []
                if text and a_bytes.joined(a).tobytes() == raw == encode_b.bytes.joined(b).tobytes():
                    i, j, n = token_links(a_bytes.size[a], encode_b.bytes.size[b], kind)
                    links = [dict(zip(("a_token", "b_token", "a_id", "b_id", "shared"), x)) for x in zip(i.tolist(), j.tolist(), a[i].tolist(), b[j].tolist(), n.tolist())]
                out.append(links)
            yield pd.DataFrame({"doc_id": list(pdf["doc_id"]), "links": out})

    kind_of = "doc_id string, links array<struct<a_token: int, b_token: int, a_id: int, b_id: int, shared: int>>"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, kind_of)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
