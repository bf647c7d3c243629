"""Quality rules by repetition coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.frames import quoted
from tablewright.llm.textblocks import ODD, blocks, grams, mix, per_text

# Per cent of a text's word characters.
TOP_GRAMS = {2: 20, 3: 18, 4: 16}
REPEATED_GRAMS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_SHARE, LINE_CHARS, BASE_WORDS, BASE_REPEATS = 30, 20, 50, 50
# Symbols for a hundred words.
SYMBOL_SHARE = 10

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words",
          *(f"top_{n}gram_chars" for n in TOP_GRAMS), *(f"dup_{n}gram_chars" for n in REPEATED_GRAMS)]

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _groups(keys: np.ndarray):
    """Order that brings equal keys together in order of appearance, and where each run starts."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return order, fresh


def _keys(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    return mix(hashes ^ (of.astype(np.uint64) * ODD))


def _covered(marked: np.ndarray, at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` words lie in one of the marked n-word windows."""
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, at[marked], 1)
    np.add.at(steps, at[marked] + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(block) -> dict[str, np.ndarray]:
    """All counts of COUNTS for the texts of one block."""
    n = block.n
    starts, ends, of = block.words()
    size = block.lengths(starts, ends)
    words = block.hashes(starts, ends)
    out = {"n_words": per_text(np.ones(len(of)), of, n), "word_chars": per_text(size, of, n)}
    symbols = np.flatnonzero(_SYMBOLS[block.data])
    out["n_symbols"] = per_text(np.ones(len(symbols)), block.text_of(symbols), n)

    first, last, line_of = block.lines()
    before = np.searchsorted(starts, first, "left")
    until = np.searchsorted(starts, last, "left")
    filled = until > before
    first, last, line_of, before, until = (x[filled] for x in (first, last, line_of, before, until))
    chars = np.concatenate([[0], np.cumsum(size)])
    again = np.zeros(len(first), dtype=bool)
    order, fresh = _groups(_keys(block.hashes(first, last), line_of))
    again[order] = ~fresh
    out["n_lines"] = per_text(np.ones(len(first)), line_of, n)
    out["n_dup_lines"] = per_text(again, line_of, n)
    out["dup_line_chars"] = per_text(again * (chars[until] - chars[before]), line_of, n)

    for length in (3, *TOP_GRAMS, *REPEATED_GRAMS):
        hashes, at = grams(words, of, length)
        order, fresh = _groups(_keys(hashes, of[at]))
        run = np.cumsum(fresh) - 1
        count = np.bincount(run, minlength=0) if len(run) else np.zeros(0, dtype=np.int64)
        if length == 3 and "n_repeat_words" not in out:
            twice = np.zeros(len(at), dtype=bool)
            twice[order] = count[run] > 1
            covered = _covered(twice, at, 3, len(of))
            out["n_repeat_words"] = per_text(covered, of, n)
        elif length in TOP_GRAMS:
            head = at[order[fresh]]
            total = np.where(count > 1, count * (chars[head + length] - chars[head]), 0)
            top = np.zeros(n, dtype=np.int64)
            np.maximum.at(top, of[head], total)
            out[f"top_{length}gram_chars"] = top
        else:
            later = np.zeros(len(at), dtype=bool)
            later[order] = ~fresh
            covered = _covered(later, at, length, len(of))
            out[f"dup_{length}gram_chars"] = per_text(covered * size, of, n)
    return out


def repetition_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and repetition counts of every whole text.

    A word is a run without ASCII white space. Word characters are code points in words. A repeated line is a
    line with a word that equals an earlier one; `top_Ngram_chars` is the largest count times characters of an
    n-gram that occurs at least twice; `dup_Ngram_chars` are the characters of words inside an n-gram that
    occurred before. A null or empty text has only zeros; rows are kept as they are, also repeated or null keys;
    other columns are not looked at. Memory follows the longest text.
    """
    schema = df.select(quoted(key)).schema
    kind = schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            parts = [measure(block) for _, block in blocks(batch.column(1))]
            columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["key", *COUNTS])

    counted = df.select(quoted(key).alias("key"), quoted(text).alias("text")).mapInArrow(
        run, "key " + kind + "".join(f", {c} long" for c in COUNTS))
    return counted.withColumnRenamed("key", key)


def verdicts(counts: DataFrame) -> DataFrame:
    """Adds base_failed, and kept: no base failure, few symbols and every repetition measure within its limit."""
    chars = F.col("word_chars")
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    bad = (100 * F.col("n_dup_lines") > LINE_SHARE * F.col("n_lines")) | (100 * F.col("dup_line_chars") > LINE_CHARS * chars)
    bad = bad | (100 * F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words"))
    for n, share in TOP_GRAMS.items():
        bad = bad | (100 * F.col(f"top_{n}gram_chars") > share * chars)
    for n, share in REPEATED_GRAMS.items():
        bad = bad | (100 * F.col(f"dup_{n}gram_chars") > share * chars)
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)
