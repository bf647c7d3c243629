"""Near-duplicates, vectors, mixing, components and the pipeline against brute force."""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the workers

import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import mixture, queries
from tablewright.llm.components import components
from tablewright.llm.neardup import near_duplicates, without_near_duplicates
from tablewright.llm.vectors import buckets, near_vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(230)] + [(5, 5), (1000, 1001), (1001, 1002), (1002, 1003)] + [(500, i) for i in range(501, 560)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges + edges[:9] + [(None, 1), (2, None)], "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == classes(nodes, [e for e in edges if e[0] != e[1]])
    assert components(df.limit(0), "a", "b").count() == 0


def shingles(text, n):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text or "")]
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def some_documents():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(500)]

    def edited(text, k):
        words = text.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    bases = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 160))) for _ in range(25)]
    texts = [None, "", " ", "a", "A", "a b", "one two three", *bases]
    for base in bases[:8]:
        texts += [edited(base, k) for k in (0, 1, 1, 2, 3, 5, 8)] + [base.upper()]
    # a family of many variants of one text, some of them near each other only, and texts that share a long passage
    texts += [edited(bases[9], rng.randint(0, 9)) for _ in range(80)]
    texts += [bases[10] + " " + " ".join(rng.choices(vocabulary, k=120)) for _ in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, n, percent):
    texts = some_documents()
    sets = [shingles(t, n) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = classes(range(len(texts)), edges)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("s1", F.lit("x"))
    df = df.union(df.limit(5)).union(spark.createDataFrame([(None, "a b", 1, "x"), (None, None, 1, "x")], df.schema))
    got = near_duplicates(df, shingle=n, percent=percent)
    rows = got.filter("doc_id is not null").collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    assert got.filter("doc_id is null and component_id is null and kept").count() == 2


def test_without_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(3, text, "k"), (2, text, "k"), (2, text, "k"), (7, "other " + text[:40], "k"), (None, text, "k")], "doc_id long, text string, key string")
    got = without_near_duplicates(df)
    assert got.columns == df.columns and sorted((r.doc_id or -1) for r in got.collect()) == [-1, 2, 7]
    assert near_duplicates(df.limit(0)).count() == 0 and without_near_duplicates(df.limit(0)).count() == 0


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24))
    parts = [base, base[:10], 3 * base[10:20]]
    for cosine in (0.99, 0.95, 0.91, 0.89):
        side = rng.normal(size=(40, 24))
        unit = base[:40] / np.linalg.norm(base[:40], axis=1, keepdims=True)
        side -= (side * unit).sum(1, keepdims=True) * unit
        parts.append(cosine * unit + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True))
    parts.append(base[50] + 0.08 * np.linalg.norm(base[50]) * rng.normal(size=(150, 24)) / math.sqrt(24))
    x = np.concatenate(parts).astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    want = classes(range(len(x)), list(zip(*map(list, np.nonzero(linked)))))
    odd = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [1.0, None] + [0.0] * 22), (9005, [float("nan")] * 24), (9006, [float("inf")] * 24),
           (9007, [1.0] * 5), (9008, [1.0] * 5), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + odd + odd[:2], "vec_id long, embedding array<float>").withColumn("bucket", F.lit(0))
    rows = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(rows) == len(x) + len(odd)
    recall = sum(rows[i].n_links for i in range(len(x))) / linked.sum()
    assert 0.99 <= recall <= 1 and all(rows[i].n_links <= linked[i].sum() for i in range(len(x)))
    if recall == 1:
        assert {i: rows[i].component_id for i in range(len(x))} == want
    assert all(rows[i].n_links == 0 and rows[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006, None))
    assert rows[9007].n_links == rows[9008].n_links == 1 and rows[9008].component_id == 9007
    assert near_vectors(df.limit(0)).count() == 0


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 600, 2500])), rng.choice(["a", "a", "a", "b", "ç", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "x y", "empty?"), (None, "x y z", "b")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("pass", F.lit(2))
    sized = mixture.sized_documents(df)
    targets = {r.source: r for r in mixture.source_targets(sized).collect()}
    total = sum(r.source_size for r in targets.values())
    assert abs(sum(r.target for r in targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(r.target <= 2 * r.source_size for r in targets.values())
    order = sorted((s for s in targets if s is not None)) + [None]
    weights = dict(zip(order, [3, 1, 2] * 3))
    free = [targets[s].target / weights[s] for s in order if targets[s].target < 2 * targets[s].source_size]
    assert max(free) - min(free) < 1e-6 * total
    drawn = mixture.mixture(sized, mixture.source_targets(sized), shards=5).cache()
    blocks = drawn.collect()
    assert len({(r.doc, r.copy, r.block, r["pass"]) for r in blocks}) == len(blocks)
    per_shard = [sum(r.shard == s for r in blocks) for s in range(5)]
    assert max(per_shard) - min(per_shard) <= 3
    for source, row in targets.items():
        got = sum(r.words for r in blocks if r.source == source)
        assert abs(got - row.target) <= 512
    mixed = sorted(map(repr, mixture.mixed_documents(df, shards=5).collect()))
    assert mixed == sorted(map(repr, mixture.mixed_documents(df.repartition(3), shards=5).collect()))
    taken = mixture.mixed_documents(df, shards=5).collect()
    assert len(taken) == df.count() and all(sum(r.shard_words) <= 2 * r.size and len(r.shard_words) == 5 for r in taken)
    for s in range(5):
        assert sum(r.shard_words[s] for r in taken) == sum(r.words for r in blocks if r.shard == s)
    assert mixture.mixed_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixture.mixed_documents(df.withColumnRenamed("doc_id", "size"), key="size")


def test_shard_draws_follow_the_tree(spark):
    """Blocks that a shard draws of a source are as many as the tree gives it."""
    rows = [(i, "w " * (100 + 37 * i), "abc"[i % 3]) for i in range(120)]
    sized = mixture.sized_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    targets = mixture.source_targets(sized)
    quotas = mixture.source_quotas(mixture.ranked_blocks(sized), targets)
    want = {(r.source, r.shard): r.until - r.first for r in mixture.shard_quotas(quotas, 7).collect() if r.until > r.first}
    drawn = mixture.mixture(sized, targets, shards=7)
    assert {(r.source, r.shard): r["count"] for r in drawn.groupBy("source", "shard").count().collect()} == want


def test_shards_are_shuffled_locally(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([5, 600, 1400]))), rng.choice(["a", "b"])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixture.sized_documents(df)
    drawn = mixture.mixture(sized, mixture.source_targets(sized), shards=3).cache()
    rows = mixture.shard_rows(df, drawn)
    parts = mixture.shuffled_locally(rows, drawn.count(), 3).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    places = sorted(parts.collect(), key=lambda r: r["at"])
    for part in {r.part for r in places}:
        got = [(r.shard, r.spot) for r in places if r.part == part]
        assert got == sorted(got)
    assert [r.row.doc_id for r in places] != sorted(r.row.doc_id for r in places)
    assert len({(r.shard, r.part) for r in places}) == 3
    wide = mixture.shuffled_locally(rows, 3 * 4 * mixture.SLICE_ROWS, 3).withColumn("part", F.spark_partition_id()).collect()
    assert len(wide) == len(places) and len({r.part for r in wide}) > 3
    texts = mixture.drawn_texts(df, drawn, shards=3)
    assert texts.columns == df.columns and sorted(map(repr, texts.collect())) == sorted(repr(r.row) for r in places)
    words = sorted(w for r in places for w in r.row.text.split())
    blocks = {r.doc: r.doc_id for r in df.select("doc_id", mixture._doc(F.col("doc_id"), F.col("source"), F.col("text")).alias("doc")).collect()}
    full = {r.doc_id: r.text.split() for r in df.collect()}
    assert words == sorted(w for r in drawn.collect() for w in full[blocks[r.doc]][r.block * 512:(r.block + 1) * 512])


def test_mixture_keeps_rows_with_one_key_apart(spark):
    """Null and repeated keys: each row is sized, drawn and written by itself, no text is cut or empty."""
    rows = [(None, "a " * 900, "s1", 1), (None, "b " * 700, "s1", 2), (None, None, "s2", 3), (5, "c " * 2000, "s1", 4), (5, "d e f", "s2", 5),
            (5, "d e f", "s2", 6), (6, "", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pass long")
    mixed = mixture.mixed_documents(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in mixed) == [(0, 0), (0, 700), (0, 900), (5, 3), (5, 3), (5, 2000), (6, 0)]
    assert all(sum(r.shard_words) <= 2 * r.size for r in mixed)
    sized = mixture.sized_documents(df)
    drawn = mixture.mixture(sized, mixture.source_targets(sized, share=2.0)).cache()
    texts = mixture.drawn_texts(df, drawn).collect()
    words = {}
    for r in texts:
        assert r.text
        for w in r.text.split():
            words[w, r.doc_id] = words.get((w, r.doc_id), 0) + 1
    assert words == {("a", None): 1800, ("b", None): 1400, ("c", 5): 4000, ("d", 5): 4, ("e", 5): 4, ("f", 5): 4}


def test_copies_are_numbered_in_steps(spark, monkeypatch):
    monkeypatch.setattr(mixture, "COPIES", 4)
    df = spark.createDataFrame([(1, "x y", "s")] * 11 + [(2, "z", None)], "doc_id long, text string, source string")
    sized = mixture.sized_documents(df)
    assert sorted((r.key, r.size, r.copy) for r in sized.collect()) == [(1, 2, i) for i in range(11)] + [(2, 1, 0)]


def test_shard_quotas_are_hypergeometric(spark):
    """Counts of one source in half of the blocks have the mean and the variance of the distribution."""
    quotas = spark.createDataFrame([("a", 60), ("b", 100), (None, 40)], "source string, quota long")
    counts = []
    for seed in range(40):
        rows = mixture.shard_quotas(quotas, 2, f"s{seed}").collect()
        assert sum(r.until - r.first for r in rows if r.shard == 0) == 100 and sum(r.until - r.first for r in rows) == 200
        counts.append(next(r.until - r.first for r in rows if r.shard == 0 and r.source == "a"))
    mean, variance = 30, 100 * 0.3 * 0.7 * 100 / 199
    assert abs(np.mean(counts) - mean) < 4 * math.sqrt(variance / 40) and 0.3 * variance < np.var(counts) < 2.2 * variance


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for table in ("documents", "embeddings"):
        duck.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    result = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = sorted(map(repr, (tuple(r) for r in result.fetchall())))
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.load(spark, folder, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, before, folder), name)
        if name == "toxicity":
            scores = queries.QUERIES["op4_toxicity"](spark, folder)
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.filter("predicted = 0").collect()}
        elif name == "near_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            sets = {i: shingles(t, 5) for i, t in texts.items()}
            edges = [(i, j) for i in texts for j in texts if j < i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            assert {r.doc_id for r in after.collect()} == {i for i, c in classes(list(texts), edges).items() if i == c}
        elif name == "pii":
            assert after.count() == before.count() and not any("4785380592391139" in (r.text or "") for r in after.collect())
        elif name == "mixing":
            size = before.agg(F.sum(F.regexp_count("text", F.lit(mixture.WORD)))).first()[0]
            taken = after.agg(F.sum(F.regexp_count("text", F.lit(mixture.WORD)))).first()[0]
            assert abs(taken - 1.5 * size) <= 512 * 25 and after.filter("text is null or text = ''").isEmpty()
        if name != "sentencepiece":
            assert after.columns == docs.columns
        before = after
    assert before.filter("n_tokens <> size(ids) or n_tokens = 0").count() == 0


@pytest.mark.parametrize("size, least", [(64, 0.99), (384, 0.97), (768, 0.96), (1536, 0.95)])
def test_recall_of_buckets_by_width(size, least):
    """Pairs at a cosine of exactly 0.9 that share a bucket."""
    rng = np.random.default_rng(size)
    a = rng.normal(size=(300, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(300, size))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.mean([len(set(x) & set(y)) > 0 for x, y in zip(buckets(a).tolist(), buckets(b).tolist())])
    print(size, met)
    assert met >= least
