"""Alignment: matrix products by hand, and digests against a walk over both token sequences."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from quire.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(90001, None), (90002, ""), (90003, " "), (90004, "▁q x"), (90005, "a  b\t\n c\n d  \n "), (90006, "<|endoftext|> hi <s>"), (90007, "\x1c x\x1c y\x85z 。日本 語😀"), (90008, "x" * 5000), (90008, "x" * 5000), (None, "\n\n foo  bar")]


def test_products():
    m, n = np.array([[1, 1, 0], [0, 0, 1]]), np.array([[1, 0], [1, 1], [0, 1]])
    csr = lambda x: align.Csr(np.concatenate([[0], np.cumsum(x.sum(1))]), np.nonzero(x)[1], x.shape[1])
    got = np.zeros((2, 2), dtype=int)
    i, j, v = csr(m).times(csr(n))
    got[i, j] = v
    assert (got == m @ n).all()
    t = csr(n).transpose()
    assert t.ptr.tolist() == [0, 2, 4] and t.cols.tolist() == [0, 1, 1, 2]


def test_links_of_each_kind():
    a, b = np.array([2, 1, 3]), np.array([3, 2, 1])  # ends 2 3 6 and 3 5 6
    of = lambda kind: list(zip(*(x.tolist() for x in align.token_links(a, b, kind))))
    assert of("overlap") == [(0, 0, 2), (1, 0, 1), (2, 1, 2), (2, 2, 1)]
    assert of("end") == [(1, 0, 1), (2, 2, 1)]
    assert of("group") == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (2, 2, 1)]


def walked(rows):
    """What the contract asks for, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), align.byte_letters()
    t.encode_special_tokens = True
    bytes_a = {i: bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x, i in t.get_vocab().items()}
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    out, count = [], Counter()
    for key, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        if not text or not b"".join(bytes_a[i] for i in a) == b"".join(bytes_b[i] for i in b) == (" " + text).encode():
            out.append((key, 0, 0, 0, [], ""))
            continue
        ends = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            ends.append({e: k for k, e in enumerate(np.cumsum([len(of[i]) for i in ids]).tolist())})
        both = sorted(set(ends[0]) & set(ends[1]))
        links, groups, x, y = [(a[ends[0][e]], b[ends[1][e]]) for e in both], [], 0, 0
        for e in both:
            groups.append(",".join(map(str, a[x : ends[0][e] + 1])) + "|" + ",".join(map(str, b[y : ends[1][e] + 1])))
            x, y = ends[0][e] + 1, ends[1][e] + 1
        count.update(links)
        out.append((key, len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted((str(k), a, b, g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), h) for k, a, b, g, x, h in out)


def test_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = align.alignment_digests(docs.withColumn("node", F.lit("clash")), A, B).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == walked([(r.doc_id, r.text) for r in docs.collect()])


def test_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "hello there"), (2, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r.links for r in align.align_texts(df, A, B).collect()}
    assert got[2] == got[None] == [] and {(x.a_token, x.b_token) for x in got[1]} >= {(0, 0)}
    assert align.alignment_digests(df.limit(0), A, B).collect() == []


def test_a_last_space(spark):
    rows = [(1, "a "), (2, "x y "), (3, "a  "), (4, "é \n "), (5, "a")]
    got = align.alignment_digests(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == walked(rows) and all(r.n_a for r in got)
