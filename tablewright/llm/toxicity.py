"""Toxicity by a weighted lexicon, learned from labels and matched by Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.frames import in_batches, quoted, stored

# Letters of other scripts that look like Latin ones, digits and signs used in place of letters.
HOMOGLYPHS = dict(zip("абвгеёзікмнорстухцѕјһԁԛԝαβγεηικνορτυχωɑɡı", "abbreezikmhopctyxucjhdqwabyenikvoptuxwagi"))
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "l", "|": "l", "€": "e"}
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "pond scum", "soap scum",
              "loser bracket", "worthless check")

# Rows of labels that a fit takes, by hash (about; all of a smaller table).
SAMPLE_ROWS = 20_000
# Different entries that a task counts before they go to the shuffle.
HELD_ENTRIES = 100_000
PREFIXES = (4, 5, 6, 7)
# An entry stands in this many toxic texts at least, and in this share of toxic ones among all it stands in.
LEAST_TEXTS, LEAST_SHARE, LEAST_Z = 8, 0.75, 6.0


def _fold_table() -> dict[int, str]:
    """Accents off, look-alikes and digits to Latin letters; i and l are one letter, as 1 stands for either."""
    table = {}
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base != chr(code):
            table[code] = base
    table |= {ord(a): b for a, b in (HOMOGLYPHS | DIGITS).items()}
    return {code: "l" if letter == "i" else letter for code, letter in table.items()} | {ord("i"): "l"}


FOLD = _fold_table()
_SIGNED = re.compile("(?<=[^\\W_])[" + re.escape("".join(SIGNS)) + "](?=[^\\W_])")
_BETWEEN = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Folded words of a text, one space before, between and after them."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    if any(sign in text for sign in SIGNS):
        text = _SIGNED.sub(lambda m: SIGNS[m[0]], text)
    return " " + _BETWEEN.sub(" ", text.translate(FOLD)).strip() + " "


def _entries(text: str) -> set[str]:
    """Whole words and beginnings of words of a folded text."""
    words = set(text.split())
    return {f" {w} " for w in words} | {" " + w[:n] for w in words for n in PREFIXES if len(w) >= n}


@dataclass
class ToxicityModel:
    """Weights of lexicon entries, exception phrases and the logistic scale of a text's weight."""
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    scale: tuple[float, float, float]

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = folded(phrase)
            found.add_word(entry, (len(entry), None))
        found.make_automaton()
        return found if len(found) else None


def _weight(automaton, text: str) -> float:
    """Sum over words of the largest weight of an entry that begins there, without words inside exception phrases."""
    if automaton is None:
        return 0.0
    best, harmless = {}, []
    for end, (length, weight) in automaton.iter(text):
        start = end - length + 1
        if weight is None:
            harmless.append((start, end))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    for start, end in harmless:
        for at in [x for x in best if start <= x < end]:
            del best[at]
    return sum(best.values())


def _features(weight: float, text: str) -> tuple[float, float]:
    """Logarithms of the weight and of the weight for each hundred words."""
    return float(np.log1p(weight)), float(np.log1p(100 * weight / (text.count(" ") + 10)))


def _count(sample: DataFrame) -> DataFrame:
    """(entry, clean, bad): texts of either label that each entry stands in."""
    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            pairs = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["entry", "clean", "bad"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                for entry in _entries(folded(text.as_py())):
                    counts.setdefault(entry, [0, 0])[toxic] += 1
                if len(counts) >= HELD_ENTRIES:
                    yield flush()
                    counts.clear()
        yield flush()

    return (in_batches(sample.select("text", "toxic"), run, "entry string, clean long, bad long")
            .groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps, classes weighing alike."""
    x = np.column_stack([np.ones(len(x)), x])
    weights = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge, beta = np.diag([1e-6, 1e-4, 1e-4]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weights * (y - p)) - ridge @ beta)
        size = np.abs(step).max()
        beta = beta + step * min(1, 4 / max(size, 1e-12))
        if size < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit_toxicity(texts: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
                 exceptions: tuple[str, ...] = EXCEPTIONS, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns the lexicon and its scale from at most about `sample_rows` labelled texts, chosen by a hash of the key.

    Rows with a null key or label don't count; a key labelled twice is toxic if one label says so. Entries are whole
    words or word beginnings; a longer entry goes where a shorter one is as sure. No labels or no toxic ones give an
    empty lexicon. The shares are tested where they are
    counted; only the sample's keys and the entries that pass reach the driver.
    """
    known = (labels.select(quoted(key).alias("key"), quoted(toxic).cast("int").alias("toxic")).dropna()
             .groupBy("key").agg(F.least(F.lit(1), F.max("toxic")).alias("toxic")))
    total = known.count()
    if total > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    if not total:
        return ToxicityModel({}, exceptions, (-30.0, 0.0, 0.0))
    sample = stored(texts.select(quoted(key).alias("key"), quoted(text).alias("text")).join(F.broadcast(known), "key"), "labelled")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    rate = n.get(1, 0) / max(1, sum(n.values()))
    if not 0 < rate < 1:
        return ToxicityModel({}, exceptions, (30.0 if rate else -30.0, 0.0, 0.0))

    both = F.col("clean") + F.col("bad")
    z = (F.col("bad") - both * rate) / F.sqrt(both * (rate * (1 - rate)))
    toxic_ones = _count(sample).filter((F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= LEAST_SHARE * both) & (z >= LEAST_Z))
    chosen: dict[str, float] = {}
    for entry, share in sorted(toxic_ones.select("entry", ((F.col("bad") + 0.5) / (both + 1)).alias("share")).collect(), key=lambda x: (len(x[0]), x[0])):
        shorter = [chosen[entry[:k]] for k in range(1, len(entry)) if entry[:k] in chosen]
        if not any(other >= share - 0.02 for other in shorter):
            chosen[entry] = share
    odds = np.log(rate / (1 - rate))
    weights = {entry: float(np.log(share / (1 - share)) - odds) for entry, share in chosen.items()}
    model = ToxicityModel(weights, exceptions, (float(odds), 0.0, 0.0))
    if not weights:  # nothing to tell texts apart by: all get the share of toxic ones
        return model
    rows = _featured(sample, model, ["toxic"]).select("toxic", "x1", "x2").collect()
    a, b, c = _logistic(np.array([[r.x1, r.x2] for r in rows]), np.array([r.toxic for r in rows]))
    model.scale = min(a, -0.1), b, c  # without a match a text is not toxic
    return model


def _featured(df: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    fields = df.select(*keep, "text").schema.fields[:-1]

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = folded(value.as_py())
                rows.append(_features(_weight(automaton, text), text))
            values = np.array(rows).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(values[:, 0]), pa.array(values[:, 1])], [*keep, "x1", "x2"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return in_batches(df.select(*keep, "text"), run, kinds + "x1 double, x2 double")


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, score (0 to 1) and predicted (1 if the score is at least 0.5) of every row, from the text alone.

    A null or empty text has no matches and gets the lowest score; rows stay as they are, also repeated ones; other
    columns are not looked at.
    """
    a, b, c = model.scale
    names = [f"k{i}" for i in range(len(keep))]
    rows = _featured(df.select(*[quoted(c).alias(n) for n, c in zip(names, keep)], quoted(text).alias("text")), model, names)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x1") + F.lit(c) * F.col("x2"))))
    scored = rows.select(*[F.col(n).alias(k) for n, k in zip(names, keep)], score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: str = "doc_id"):
    """Rows that no fit of the registered queries sees."""
    return F.crc32(quoted(key).cast("string")) % 5 == 0
