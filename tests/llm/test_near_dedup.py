"""The pipeline's near-dedup stage against Jaccard similarity by brute force."""

import time
import tracemalloc
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import common, langid, similar
from quire.llm.common import words_of


def brute_force(rows):
    """The smallest doc_id of each group of texts linked by a five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for r in rows:
        w = words_of(r.text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    different = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b)):
                different += a != b
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(r.doc_id, least.get(root(i), r.doc_id))
    return set(least.values()), different


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_dedup_against_jaccard(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want, different = brute_force(docs.collect())
    assert different
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == want


def test_near_dedup_chains_and_repeats(spark):
    rng = np.random.default_rng(7)
    word = [f"w{k}" for k in range(5000)]
    base = list(rng.choice(word, 300))
    rows, chain = [], list(base)
    for i in range(12):  # each is similar to the one before, the last isn't to the first
        rows.append((i, " ".join(chain)))
        chain[20 * i : 20 * i + 4] = rng.choice(word, 4)
    rows.append((20, " ".join(base) + " as it was said" * 200))  # a repeated line is a few shingles
    rows += [(30, ""), (31, None), (32, " ".join(rng.choice(word, 300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, _ = brute_force(docs.collect())
    assert want == {0, 30, 32}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == want


def test_short_texts_just_at_the_bound(spark):
    """Nine words and the first eight of them share four of five shingles, however many bits of a fingerprint differ."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        w = [f"w{x}" for x in rng.integers(0, 1 << 40, 9)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:8]))]
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i - i % 2) for i in range(1200)}


def test_parities_differ_no_more_than_the_sets():
    rng = np.random.default_rng(7)
    for n, m in ((5, 1), (40, 9), (300, 60), (0, 3)):
        s = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = s[: n + m // 2], s[m // 2 :]
        assert ((similar.parity(a) ^ similar.parity(b)) & (1 << 64) - 1).bit_count() <= len(np.setxor1d(a, b))


def test_only_shingles_of_each_set_are_written(spark, monkeypatch):
    """Texts that are held against others are read where they are needed, sets of hashes aren't stored for it; ids that repeat with the same and other texts do no harm."""
    rng = np.random.default_rng(8)
    word = [f"w{k}" for k in range(5000)]
    a, b = " ".join(rng.choice(word, 200)), " ".join(rng.choice(word, 200))
    rows = [(5, a), (5, a), (5, b), (1, a + " one more"), (7, b + " and more"), (7, b + " and more"), (9, " ".join(rng.choice(word, 50)))]
    arrays, write = set(), similar.materialise

    def recorded(df, tag):
        if any(f.dataType.typeName() == "array" for f in df.schema):
            arrays.add(tag)
        return write(df, tag)

    monkeypatch.setattr(similar, "materialise", recorded)
    got = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert arrays == {"sets", "one"}
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (5, 5), (7, 5), (7, 5), (9, 9)]


def test_parities_tell_larger_sets_apart():
    """Sets of 400 shingles that share half of them differ in more bits than sets of that size may that are similar; those that are differ in no more bits than shingles."""
    rng = np.random.default_rng(10)
    s = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    differ = lambda a, b: int(np.bitwise_count(similar.parities(a) ^ similar.parities(b)).sum())
    assert differ(s[:400], s[200:]) > 800 - 2 * 356 and differ(s[:400], s[40:440]) <= 80


def test_a_shared_passage_is_one_block_and_few_pairs(spark, monkeypatch):
    """Texts that share a passage meet at its first shingle only, and most of them are told apart before their texts are fetched; those that are similar are found all the same."""
    rng = np.random.default_rng(11)
    passage, rows = [f"p{k}" for k in range(150)], []
    for i in range(40):
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, 150)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join([*passage, *own[:-4]]))]
    blocks, asked, write, confirm = [], [], similar.materialise, similar.confirmed

    def recorded(df, tag):
        out = write(df, tag)
        if tag == "blocks":
            blocks.append(out.select("shingle").distinct().count())
        return out

    def counted(pairs, *more):
        asked.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(similar, "LEAST_SEEN", 1 << 30)  # no shingle is known to be common
    monkeypatch.setattr(similar, "materialise", recorded)
    monkeypatch.setattr(similar, "confirmed", counted)
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i - i % 2) for i in range(80)}
    assert sum(asked) <= 200 and max(blocks) <= 80 * 12


def test_scratch_of_near_dedup_goes_before_its_result_is_written(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 30, "en") for i in range(20)] + [(3, "again", "en")], "doc_id long, text string, lang string")
    before = len(common.MADE)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert len(common.MADE) == before + 2
    assert kept.select("doc_id").distinct().count() == 20


def test_tables_go_as_soon_as_they_are_not_read(spark, monkeypatch):
    """From the first comparison of texts on the sets are gone, blocks are narrow, and only the latest ones are there."""
    there, write, confirm = [], similar.materialise, similar.confirmed
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def recorded(df, tag):
        out = write(df, tag)
        if tag == "blocks":
            assert set(out.columns) == {"node", "shingle", "at", "n", "root"}
        there.append((tag, common.MADE[-1]))
        return out

    def counted(*x):
        now = [tag for tag, name in there if name in common.MADE]
        assert "sets" not in now and "shared" not in now and now.count("blocks") <= 1 and now.count("roots") == 0
        return confirm(*x)

    monkeypatch.setattr(similar, "materialise", recorded)
    monkeypatch.setattr(similar, "confirmed", counted)
    assert similar.similar_components(docs).count() == docs.count() and len(there) > 10


def test_shuffle_files_go_with_their_query(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum("shuffle_" in str(f) for f in str(blocks.getAllFiles().mkString(" ")).split(" "))
    before, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    with common.passing_scratch(spark):
        common.materialise(spark.range(1000).repartition(4, "id"), "some")
        assert spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
        for _ in range(50):
            if shuffled() <= before:
                break
            time.sleep(0.1)
        assert shuffled() <= before
    assert spark.conf.get(common.CLEANUP, None) == setting


def test_shared_shingles_of_packed_ones(monkeypatch):
    """Shingles of several sets come back with all rows and places, whatever the tasks, chunks and shards; the hashes tell equal groups of rows from others."""
    rng = np.random.default_rng(12)
    sets = {(1 << 33) * (i % 3) + i: np.unique(np.concatenate([rng.integers(-1 << 63, 1 << 63, 30), rng.integers(0, 40, 8) << 57])) for i in range(100)}
    sets[5], sets[1 << 40] = np.empty(0, dtype=np.int64), np.array([-2, -1])
    sets[2 << 40] = sets[1 << 40]
    want = defaultdict(dict)
    for row, s in sets.items():
        for at, x in enumerate(s.tolist()):
            want[x][row] = at
    want = {x: rows for x, rows in want.items() if len(rows) > 1}
    monkeypatch.setattr(similar, "PACKED", 300)
    items = list(sets.items())
    rng.shuffle(items)
    frames = [pd.DataFrame({"row": [r for r, _ in items[a : a + 7]], "firsts": [s for _, s in items[a : a + 7]]}) for a in range(0, len(items), 7)]
    packed = pd.concat([*similar.packer(5)(iter(frames[:6])), *similar.packer(5)(iter(frames[6:]))])
    found = [similar.shared_shingles(x) for _, x in packed.groupby("shard")]
    assert len(found) == 5
    got, kinds = defaultdict(dict), defaultdict(set)
    for x in pd.concat(found).itertuples():
        got[x.shingle][x.row] = x.at
        if x.c:
            kinds[x.c, x.g, x.h].add(x.shingle)
            assert x.c == len(want[x.shingle]) and x.places == sum(want[x.shingle].values())
    assert got == want
    groups = defaultdict(set)
    for x, rows in want.items():
        groups[frozenset(rows)].add(x)
    assert sorted(map(sorted, kinds.values())) == sorted(map(sorted, groups.values())) and {-2, -1} in kinds.values()


def test_long_texts_are_told_apart_before_they_are_fetched(spark, monkeypatch):
    """Of long texts that share half of their words none is fetched for another, though 1,024 bits can't tell them apart; similar ones are found, also across a doubling of the parities."""
    rng = np.random.default_rng(13)
    passage, rows = [f"p{k}" for k in range(2000)], []
    for i in range(12):
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, 2000)]
        rows.append((2 * i, " ".join(passage + own)))
        rows.append((2 * i + 1, " ".join([*passage, *own[:-100], *[f"v{x}" for x in rng.integers(0, 1 << 40, 100 + 20 * i)]])))
    asked, confirm = [], similar.confirmed

    def counted(pairs, *more):
        asked.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(similar, "LEAST_SEEN", 1 << 30)  # no shingle is known to be common
    monkeypatch.setattr(similar, "confirmed", counted)
    found = similar.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i - i % 2) for i in range(24)}
    assert sum(asked) <= 40
    a, b = (similar.wide_parities(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))) for n in (4096, 4097))
    assert len(similar.wide_parities(np.arange(1024, dtype=np.uint64))) == 0 and 64 * len(a) == 4096 and len(b) == 2 * len(a)


def test_workers_hold_a_part_of_a_batch(monkeypatch):
    """An executor's workers keep the most memory they ever took, from stage to stage; what they take goes with a part of the Arrow batch, and the parts change no result."""
    rng = np.random.default_rng(9)
    word = np.array([f"w{k}" for k in range(3000)])
    texts = [" ".join(x) for x in rng.choice(word, (4000, 400))] + [None, "", " "]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    mark = similar.marker(SimpleNamespace(value=(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))), 5, 80, 42)
    model = langid.LanguageModel(["a", "b"], np.log(rng.dirichlet(np.ones(1 << 16), 2)), 16)
    got, most = [], []
    tracemalloc.start()
    for part in mark(iter([pdf])):
        got += zip(part["doc_id"], part["node"])
        most.append(len(part))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    logs = langid.score_batch(model, [t or "" for t in texts])
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert got == [(i, similar.node_of(similar.shingle_set(t, 5, 42))) for i, t in enumerate(texts)]
    assert max(most) < len(texts) / 4 and peak < 64 << 20
    monkeypatch.setattr(langid, "SLICE", 2 << 20)
    assert np.array_equal(logs, langid.score_batch(model, [t or "" for t in texts]))


@pytest.mark.parametrize("stage", [corpus_pipeline.language, corpus_pipeline.near_dedup, corpus_pipeline.encode])
def test_batches_of_texts_are_small(spark, stage):
    """What a stage returns is planned by the caller's write, and then too its workers get few rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        docs = spark.range(1).selectExpr("id as doc_id", "'a few words' as text", "'en' as lang")
        assert stage(spark, docs, "").columns
        sizes = spark.range(0, 2500, 1, 1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(x)]}) for x in batches), "n long")
        assert max(r.n for r in sizes.collect()) <= corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(name, before)
