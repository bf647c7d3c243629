"""Phrases, the conversation trie and the quality classifier against brute force and held-out labels."""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the workers

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import phrases, queries, trie
from tablewright.llm.subwords import features, fit_quality, score_quality
from tablewright.llm.textblocks import blocks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


# Phrases

def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_collocations(rows, least, top):
    total, f = Counter(), Counter()
    for lang, text in rows:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang or "und", tuple(words[i:i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, words), a in found.items():
        inside = any(other == lang and len(longer) > len(words) and b >= a and any(longer[i:i + len(words)] == words for i in range(len(longer)))
                     for (other, longer), b in found.items())
        if inside:
            continue
        n = total[lang]
        score, k = min((1000 * a * n // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n))
    return {(lang, rank, p.decode(), -a, l, r, n, -s) for lang, found in out.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:top], 1)}


def some_texts():
    rng = random.Random(5)
    vocabulary = ["a", "b", "Ça", "the", "The", "x" * 40, "é", "🙂"]
    rows = [(rng.choice(["en", None, "und", "de"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(rng.randint(0, 60))))
            for _ in range(120)]
    return rows + [("en", None), ("en", ""), (None, " \t"), ("fr", "no one"), *rows[:5]]


def test_collocations_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_ENTRIES", 50)
    rows = some_texts()
    df = spark.createDataFrame([(lang, text, 1, "z") for lang, text in rows], "lang string, text string, n int, phrase string")
    for least, top in ((5, 12), (2, 1000)):
        got = {tuple(r) for r in phrases.collocations(df, least=least, top=top).collect()}
        assert got == brute_collocations(rows, least, top)
        assert len(got) > 20
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.filter("text is null")).count() == 0


def test_colliding_fingerprints(spark, monkeypatch):
    """All words with one hash and a bitmap that lets everything through: the text still tells phrases apart."""
    rows = some_texts()[:40]
    marks = np.full(phrases.MARK_BITS // 8, 255, dtype=np.uint8)
    texts = pa.array([t for _, t in rows], pa.string())
    for _, block in blocks(texts, lower=True):
        known = phrases.Pieces(block, np.zeros(block.n, dtype=np.uint64))
        known.words = known.words % np.uint64(2)
        number, first = phrases._exact_words(known)
        word = lambda i: block.data[known.starts[i]:known.ends[i]].tobytes()
        assert all(word(i) == word(first[number[i]]) for i in range(len(number)))
        assert len({word(i) for i in range(len(number))}) == len(set(number.tolist()))
    assert phrases.marked(marks, np.arange(5, dtype=np.uint64)).all()


def test_large_counts_stay_exact(spark):
    big = 3_000_000_000_000
    row = spark.createDataFrame([("en", 2, "a b", big - 1), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 0, None, 20 * big)], "lang string, size int, phrase string, n long")
    phrases_of, phrases.frequent_phrases = phrases.frequent_phrases, lambda *a: row
    try:
        got = phrases.collocations(row).collect()
    finally:
        phrases.frequent_phrases = phrases_of
    assert [(r.score, r.l, r.r) for r in got] == [(1000 * (big - 1) * 20 * big // (big * (big + 7)), big, big + 7)]


# Conversations

def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    for turns in own.values():
        turns.sort()
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - conv % 20 if conv >= 0 else conv + (-conv) % 20
        whole[conv] = tuple((r, t) for _, _, r, t in [*own.get(base, [])[:h], *turns[h:]])
    nodes = {s[:d] for s in whole.values() for d in range(len(s) + 1)}
    members = {p: sorted(c for c, s in whole.items() if s[:len(p)] == p) for p in nodes}
    children = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:len(p)] == p] for p in nodes}
    out = []
    for p in nodes:
        below = [q for q in nodes if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in members[p] if whole[c] == p)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]),
                    sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, depth int, path string"


def some_conversations():
    rng = random.Random(8)
    rows = []
    for conv in [*range(0, 130), 1000, 2017, -3, -20, -45, None]:
        for turn in range(rng.randint(1, 5)):
            rows.append((conv, rng.choice([None, turn, turn, turn]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "ho  hum", "", None, "é a\tb", "1:x"])))
    rows += [(r, t, "user", f"same {t}") for r in range(200, 260) for t in range(4)]
    return rows + rows[:9]


def test_trie_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_A_TEXT", 7)
    rows = some_conversations()
    df = spark.createDataFrame([(*r, 0, "p") for r in rows], TURNS)
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.filter("conv_id is null")).count() == 0


def test_trie_of_turnless_conversations(spark):
    alone = [c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "gone") for c in alone]
    got = trie.prefix_trie(spark.createDataFrame([(*r, 0, "p") for r in rows], TURNS)).collect()
    assert [tuple(r) for r in got] == brute_trie(rows)
    assert got[0].n_convs == 3 and got[0].depth == 0 and got[0].n_leaves == 1


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_conversation_trie"])
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# Quality

def brute_features(text):
    """Words (a repeated one is a mark), pairs and character n-grams, as text."""
    words = WORDS.findall(text or "")
    marked = [b"=" if i and words[i] == words[i - 1] else w.encode() for i, w in enumerate(words)]
    out = [(1, w) for w in marked] + [(2, a + b" " + b) for a, b in zip(marked, marked[1:])]
    spaced = " " + re.sub(r"[\x20\x09-\x0D]", " ", text or "") + " "
    return out + [(3, spaced[i:i + n].encode()) for n in (3, 4, 5) for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1:i + n - 1]]


def test_features_are_those_of_each_text():
    texts = ["a a b", None, "", "  ", "äöü x\n\ny", "word", "a", "🙂🙂 🙂🙂 é", "word"]
    found = defaultdict(list)
    for first, block in blocks(pa.array(texts, pa.string())):
        for bucket, of in features(block):
            for b, t in zip(bucket.tolist(), of.tolist()):
                found[first + t].append(b)
    names = {}
    for i, text in enumerate(texts):
        want = brute_features(text)
        assert len(found[i]) == len(want), text
        assert len(set(found[i])) == len({f"{'g' if k == 3 else k}{w}" for k, w in want})
        names[text] = sorted(found[i])
    assert sorted(found[5]) == sorted(found[8])


def test_quality_held_out(spark):
    got = queries.op13_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() >= 0.97
    again = queries.op13_quality_classifier(spark, "/root/testdata/sf0.01").toPandas()
    assert (again.sort_values("doc_id").score.to_numpy() == got.sort_values("doc_id").score.to_numpy()).all()


def test_quality_odd_input(spark):
    docs = spark.createDataFrame([(1, "good text here", 5.0), (2, None, None), (2, "", 1.0), (None, "a " * 3000, 1.0), (4, "bad bad bad bad", 0.0)], "doc_id long, text string, score double")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = fit_quality(docs, labels([(1, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 1), (1, 1, 1), (99, 0, 0)]))
    scored = score_quality(docs, model, keep=("doc_id",))
    got = {(r.doc_id, r.predicted): r.score for r in scored.collect()}
    assert scored.count() == 5 and got[1, 1] > 0.7 and got[4, 0] < 0.3
    assert fit_quality(docs, labels([])).bias == 0
    assert [r.predicted for r in score_quality(docs, fit_quality(docs, labels([(1, 0, 0)]))).collect()] == [0] * 5
    assert score_quality(docs.limit(0), model).count() == 0
    assert fit_quality(docs.limit(0), labels([(1, 1, 0), (4, 0, 0)])).bias == 0
