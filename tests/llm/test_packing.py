"""Packing: pieces by the library, gapless sequences, and as few as best-fit decreasing needs."""

import bisect
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import packing

BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [(90001, None), (90002, ""), (90003, "a  b\t\n c\n d  \n "), (90004, "<|endoftext|> hi <s>"), (90005, "\x1c x\x1c y\x85z 。日本 語😀"), (90006, "x y" * 5000), (90006, "x y" * 5000), (None, "\n\n foo  bar")]


def best_fit_decreasing(sizes, length):
    gaps, n = [], 0
    for v in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, v)
        if i < len(gaps):
            left = gaps.pop(i) - v
        else:
            n, left = n + 1, length - v
        bisect.insort(gaps, left)
    return n


@pytest.mark.parametrize("rows", [packing.RANGE_ROWS, 40])
def test_pack_documents(spark, monkeypatch, rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    docs = docs.withColumn("offset", F.lit("clash")).withColumn("pid", F.lit("clash"))
    placed = packing.pack_documents(docs, BYTE_JSON, with_ids=True)
    got, t = placed.drop("ids").collect(), Tokenizer.from_file(BYTE_JSON)
    want = []
    for r in docs.collect():
        ids = (t.encode(r.text, add_special_tokens=False).ids if r.text else []) + [0]
        edges = sorted({0, len(ids) % 2048, *range(len(ids) % 2048, len(ids) + 1, 2048)})
        want += [(str(r.doc_id), k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and len(used) <= best_fit_decreasing([r.length for r in got], 2048) + 1
    for r in packing.sequences(placed).collect():
        assert len(r.ids) == used[r.sequence_id] == r.ends[-1]


def test_many_small_and_equal_sizes(spark):
    """A third of the rows have one size; many fit one sequence."""
    rng = np.random.default_rng(0)
    sizes = np.concatenate([np.full(700, 10), rng.integers(1, 120, 1300), rng.integers(300, 2047, 200)]).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "pid long, size int")
    got = packing.packed(df).collect()
    full = {}
    for r in got:
        full[r.bin] = full.get(r.bin, 0) + sizes[r.pid]
    assert sorted(r.pid for r in got) == list(range(len(sizes))) and max(full.values()) <= 2048
    assert len(full) <= best_fit_decreasing(sizes, 2048) * 1.02 + 1


def test_matching_takes_the_last_free_place():
    gap, doc = packing.matched(np.array([True, False, True, True, False, False, False]))
    assert sorted(zip(gap.tolist(), doc.tolist())) == [(0, 1), (2, 5), (3, 4)]
    assert packing.carried({0: (1, 3), 1: (2, 2), 2: (4, 0)})[0] == [(1, 0, 1, 0, 2), (2, 0, 1, 1, 1), (2, 2, 2, 0, 2)]


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE_JSON).collect() == []
