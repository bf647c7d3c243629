"""Quality of texts by supervised subword embeddings: learned vectors of hashed words, word pairs and character n-grams,
averaged over a document, with a softmax output, trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.frames import quoted, stored
from tablewright.llm.textblocks import SPACE, Block, blocks, grams

# Rows of labels that a fit takes, by hash (about; all of a smaller table), and rows for each of the models fitted side by side.
SAMPLE_ROWS, REPLICA_ROWS = 4_000, 1_000
BUCKET_BITS, WIDTH = 17, 16
CHARS, WORDS = (3, 4, 5), (1, 2)
# Texts seen by a model, in turns over its rows.
STEPS, RATE, SEED = 6_000, 0.5, 13
LIKELY = 0.3

_SHIFT = np.uint64(64 - BUCKET_BITS)
# Stands for a word that is the same as the one before it.
_AGAIN = np.uint64(0x9E6C63D0876A9A47)


def _spaced(block: Block) -> Block:
    """The block with a space around every text and each white space as a space, so that words show where they begin and end."""
    out = np.full(len(block.data) + block.n + 1, 32, dtype=np.uint8)
    of = np.repeat(np.arange(block.n), np.diff(block.bounds))
    out[np.arange(len(block.data)) + of + 1] = np.where(SPACE[block.data], 32, block.data)
    return Block(out, np.concatenate([block.bounds[:-1] + np.arange(block.n), [len(out)]]))


def features(block: Block):
    """(bucket, text) arrays of all words, word pairs and character n-grams of a block's whole texts.

    A word that repeats the one before it is one and the same word whatever it is, so that repetition has a vector too.
    """
    block = _spaced(block)
    starts, ends, of = block.words()
    words = block.hashes(starts, ends)
    words[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])] = _AGAIN
    for n in WORDS:
        prints, at = grams(words, of, n)
        yield (prints >> _SHIFT).astype(np.int64), of[at]
    points = np.flatnonzero((block.data & 0xC0) != 0x80)
    space = np.concatenate([[0], np.cumsum(block.data[points] == 32)])
    after = np.append(points, len(block.data))
    text = block.text_of(points)
    for n in CHARS:
        count = len(points) - n + 1
        if count > 0:  # a space only as the first or the last character: the n-gram begins or ends a word
            at = np.flatnonzero(space[n - 1:n - 1 + count] == space[1:count + 1])
            yield (block.hashes(points[at], after[at + n]) >> _SHIFT).astype(np.int64), text[at]


def _bags(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of all its features."""
    bags = []
    for _, block in blocks(table.column("text").combine_chunks()):
        found = list(features(block))
        buckets, of = np.concatenate([b for b, _ in found]), np.concatenate([t for _, t in found])
        keys, counts = np.unique(of << BUCKET_BITS | buckets, return_counts=True)
        bounds = np.searchsorted(keys >> BUCKET_BITS, np.arange(block.n + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            bags.append(((keys[a:b] & ((1 << BUCKET_BITS) - 1)), (counts[a:b] / max(1, counts[a:b].sum())).astype(np.float32)))
    return bags


def train(bags: list, labels: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """(advantage of label 1 for each bucket, bias): embeddings times output weights after SGD, classes weighing alike.

    The softmax over two outputs depends on their difference only, and a mean of vectors times weights is the mean of
    the products, so one number for each bucket is all that scoring needs.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((WIDTH, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    weight = np.array([len(labels) / max(1, 2 * (labels == c).sum()) for c in (0, 1)]).clip(0.1, 4)
    turns = -(-STEPS // len(bags))
    steps, done = turns * len(bags), 0
    for _ in range(turns):
        for i in rng.permutation(len(bags)):
            buckets, shares = bags[i]
            rate = RATE * (1 - done / steps) * weight[labels[i]]
            done += 1
            hidden = shares @ vectors[buckets]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            gradient = -p / p.sum()
            gradient[labels[i]] += 1
            back = output @ gradient
            output += rate * np.outer(hidden, gradient)
            bias += rate * 0.1 * gradient
            vectors[buckets] += (rate * shares)[:, None] * back
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


@dataclass
class QualityModel:
    """Mean over the models of each bucket's advantage and of the bias."""
    advantage: np.ndarray
    bias: float


def fit_quality(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learns from at most about `sample_rows` labelled texts, whole, chosen by a hash of the key.

    Rows with a null key or label don't count; a key labelled twice has the higher label. Without labels of both
    classes every text gets the same score: 1 or 0 if all labels are, a half without any. Models learn from disjoint
    parts of the sample, each in a task, in the order of a hash, so reruns agree; their advantages are averaged.
    """
    known = (labels.select(quoted(key).alias("key"), quoted(label).cast("int").alias("label")).dropna()
             .groupBy("key").agg(F.when(F.max("label") > 0, 1).otherwise(0).alias("label")))
    kinds = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(kinds.values())
    if len(kinds) < 2:
        return QualityModel(np.zeros(1 << BUCKET_BITS, dtype=np.float32), {(): 0.0, (0,): -30.0, (1,): 30.0}[tuple(kinds)])
    if total > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    order, parts = F.xxhash64("key", "text", F.lit("order")), -(-min(total, sample_rows) // REPLICA_ROWS)
    sample = stored(texts.select(quoted(key).alias("key"), quoted(text).alias("text")).join(F.broadcast(known), "key")
                    .select("text", "label", order.alias("order"), F.pmod(order, F.lit(parts)).cast("int").alias("part")), "labelled")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("order")
        advantage, bias = train(_bags(table), table.column("label").to_numpy(), SEED)
        return pa.table({"advantage": pa.array([advantage.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    fitted = sample.groupBy("part").applyInArrow(fit, "advantage binary, bias double").collect()
    if not fitted:
        return QualityModel(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0)
    tables = np.array([np.frombuffer(r["advantage"], dtype=np.float32) for r in fitted], dtype=np.float64)
    return QualityModel(tables.mean(axis=0).astype(np.float32), float(np.mean([r["bias"] for r in fitted])))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, score (0 to 1) and predicted (1 if the score is at least LIKELY) of every row, from the whole text alone.

    A null or empty text has no features and gets the score of the bias; rows stay as they are, also repeated ones; other
    columns are not looked at, and kept ones may be named like any other.
    """
    names = [f"k{i}" for i in range(len(keep))]
    slim = df.select(*[quoted(c).alias(n) for n, c in zip(names, keep)], quoted(text).alias("text"))
    advantage, bias = model.advantage, model.bias

    def run(batches):
        for batch in batches:
            logits = np.zeros(batch.num_rows)
            for first, block in blocks(batch.column("text")):
                total, count = np.zeros(block.n), np.zeros(block.n)
                for buckets, of in features(block):
                    total += np.bincount(of, weights=advantage[buckets], minlength=block.n)
                    count += np.bincount(of, minlength=block.n)
                logits[first:first + block.n] = total / np.maximum(count, 1)
            score = 1 / (1 + np.exp(-np.clip(logits + bias, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    scored = slim.mapInArrow(run, kinds + "score double").select(*[F.col(n).alias(k) for n, k in zip(names, keep)], "score")
    return scored.withColumn("predicted", (F.col("score") >= LIKELY).cast("int"))
