"""Token counts without token ids: pieces are counted once for each distinct pre-token of the corpus and joined to the
pre-token frequencies of every document.

Pre-tokens here are the parts between ASCII white space. The tokenizer drops white space and none of its steps looks
across it (NFC never composes with a space, its pattern matches no white space, its special strings hold none), so
the pieces of a text are those of its parts. Documents are packed in blocks: a block's distinct parts, and for each document
which of them it has and how often. Blocks ask shards for their parts; there each distinct part of the corpus is counted once, and
the counts go back to the blocks, where the frequencies of every document are joined to them and summed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.asking import climb, descend, split_tokens, token_shard
from quire.llm.common import Index, batched, block_count, materialise, pack, pack_sorted, unpack, unpack_sorted, zip_bytes

#: Characters of a block, shards of the distinct parts, parts that the library gets at a time.
SLICE, SHARDS, BATCH = 8 << 20, 4096, 10_000
#: Rows of a block: kind docs has ids, bytes and frequencies of its documents, kind token its distinct parts for each shard.
BLOCK = "kind string, node long, shard int, keys binary, counts binary, ids array<string>, sizes array<long>"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The library's tokenizer for a .json or .model file, one for each worker process."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def piece_counts(path: str):
    """Of a shard: number of pieces of each distinct part. Of what the library returns only the length is read: no ids leave it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load_tokenizer(path)
        for pdf in batches:
            for shard, keys in zip(pdf["shard"], pdf["keys"]):
                parts = [w.decode() for w in split_tokens(keys)]
                n = [len(x) for a in range(0, len(parts), BATCH) for x in t.encode_batch_fast(parts[a : a + BATCH], add_special_tokens=False)]
                yield pd.DataFrame([("token", int(shard), 0, keys, pack(np.array(n, dtype="<i8")))], columns=["kind", "shard", "node", "keys", "vals"])

    return run


def frequencies(texts: list[str | None], ids: Index) -> tuple[np.ndarray, np.ndarray]:
    """Part numbers of all texts, one after the other, and how many each has; `ids` gets the new parts."""
    flat: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            words = t.encode("utf-8", "replace").split()
            flat += map(ids.__getitem__, words)
            sizes[i] = len(words)
    return np.array(flat, dtype=np.int64), sizes


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def packed(shards: int):
    """Packs documents in blocks: a row with ids, bytes and frequencies (document and part in one key, and how often), and
    rows with the distinct parts of each shard. Parts are numbered in the order of the shards and, in one, of their bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batched(batches, SLICE):
            texts, block = [t if isinstance(t, str) else None for t in pdf["text"]], uuid.uuid4().int >> 65
            index = Index()
            flat, sizes = frequencies(texts, index)
            parts = list(index)
            of = token_shard(parts, shards).astype(np.int64)
            order = sorted(range(len(parts)), key=lambda i: (of[i], parts[i]))
            place = np.empty(len(parts), dtype=np.int64)
            place[order] = np.arange(len(parts))
            key, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(parts) + place[flat], return_counts=True)
            n_bytes = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            rows = [("docs", block, len(parts), pack_sorted(key.astype(np.uint64)), pack(times.astype("<i4")), list(pdf["doc_id"]), n_bytes)]
            edges = np.searchsorted(of[order], np.arange(shards + 1))
            for s in np.unique(of):
                mine = [parts[i] for i in order[edges[s] : edges[s + 1]]]
                rows.append(("token", block, int(s), zip_bytes(b" ".join(mine)), pack(np.zeros(len(mine), dtype="<i8")), None, None))
            yield pd.DataFrame(rows, columns=["kind", "node", "shard", "keys", "counts", "ids", "sizes"])

    return run


def summed(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Joins the frequencies of a block's documents to the pieces of its parts: per document the sum of times by pieces."""
    one = block.iloc[0]
    pieces = np.concatenate([np.empty(0, dtype=np.int64), *[unpack(v, "<i8") for v in told.sort_values("shard")["vals"]]])
    total = np.zeros(len(one["ids"]), dtype=np.int64)
    if len(pieces):
        doc, place = np.divmod(unpack_sorted(one["keys"]).astype(np.int64), len(pieces))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[first]] = np.add.reduceat(unpack(one["counts"], "<i4") * pieces[place], first)
    return pd.DataFrame({"doc_id": list(one["ids"]), "n_bytes": list(one["sizes"]), "n_tokens": total})


def document_token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row of `docs`.

    Null and empty texts have 0 of both. Repeated rows and null ids give a row each; an empty table gives none;
    other columns are ignored, whatever their names.
    """
    if path.endswith(".model"):
        raise ValueError("a sentencepiece model keeps white space, so its pieces aren't those of the parts")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text on the way: pandas would turn nullable longs into doubles
    shards = min(block_count(docs, SLICE), SHARDS)
    blocks = materialise(rows.mapInPandas(packed(shards), BLOCK), "blocks", "kind")
    texts, asked = blocks.filter("kind = 'docs'"), blocks.filter("kind = 'token'").select("kind", "shard", "node", "keys", "counts")
    distinct, levels = climb(asked, texts.count())
    pieces = materialise(distinct.mapInPandas(piece_counts(path), "kind string, shard int, node long, keys binary, vals binary"), "pieces")
    told = descend(pieces, levels).select("node", "shard", "vals")
    counted = texts.select("node", "keys", "counts", "ids", "sizes").groupBy("node").cogroup(told.groupBy("node")).applyInPandas(summed, "doc_id string, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
