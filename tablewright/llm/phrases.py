"""Phrase collocations: Rabin-Karp fingerprints of word n-grams decide which phrases can be frequent, texts decide what they are.

Four passes over the texts. Each of the first three counts fingerprints only - words, then pairs of frequent words, then
three to five words all of whose pairs are frequent - and leaves one bitmap of the frequent ones, of a fixed size
whatever the corpus. Two fingerprints that collide are counted together, so nothing frequent is lost. The last
pass follows the occurrence pointers of marked fingerprints into the text, tells apart what collided, and counts phrases
by their words; a phrase that only seemed frequent falls there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.frames import quoted, small_or_not, stored
from tablewright.llm.textblocks import Block, blocks, mix, powers

LEAST_COUNT, LONGEST, TOP, ABSORBED = 100, 5, 2_000, 100
# Bits of a fingerprint that the shuffle counts by; fewer let more phrases be counted together, which adds candidates only.
PRINT_BITS = 40
# Bits that mark frequent fingerprints: 8 MB in each task. A fuller map lets more through to the next pass, never less.
MARK_BITS = 1 << 26
# Where in a fingerprint its two places in the map begin.
PLACES = (0, PRINT_BITS - 26)
# Counts of several blocks go to the shuffle together.
FLUSH_ENTRIES = 1 << 21
# A language's candidates are ranked in so many parts before the best of these are ranked together.
RANK_PARTS = 64
NO_LANGUAGE = "und"

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _seed(language: str) -> int:
    return int.from_bytes(hashlib.blake2b(language.encode(), digest_size=8).digest(), "little")


class Pieces:
    """Words of a block in order, the piece and text each stands in, and fingerprints of n-grams within pieces."""

    def __init__(self, block: Block, seeds: np.ndarray):
        size = len(block.data)
        inside = ~_APART[block.data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[block.bounds] = True
        before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.block = block
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.of = block.text_of(self.starts)
        self.piece = np.cumsum(_BREAK[block.data] | edge[:-1])[self.starts]
        self.seeds = seeds[self.of]
        self.words = mix(block.hashes(self.starts, self.ends) ^ self.seeds) if size else np.zeros(0, dtype=np.uint64)
        self._sums = np.zeros(len(self.words) + 1, dtype=np.uint64)
        np.cumsum(self.words * powers(_BASE, len(self.words)), out=self._sums[1:])

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of every n words in a row within a piece, and the place of its first word."""
        count = len(self.words) - n + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.piece[:count] == self.piece[n - 1:])
        return mix((self._sums[at + n] - self._sums[at]) * powers(_INVERSE, count)[at] + np.uint64(n)) & np.uint64((1 << PRINT_BITS) - 1), at


def marked(marks: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set."""
    out = np.ones(len(prints), dtype=bool)
    for shift in PLACES:
        place = (prints >> np.uint64(shift)) & np.uint64(MARK_BITS - 1)
        out &= (marks[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _survivors(pieces: Pieces, marks: np.ndarray, n: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (fingerprint, place) all of whose runs of `part` words are marked."""
    prints, at = pieces.fingerprints(n)
    shorter, places = pieces.fingerprints(part)
    good = np.zeros(len(pieces.words) + 1, dtype=np.int64)
    good[places[marked(marks, shorter)] + 1] = 1
    run = np.cumsum(good)
    whole = run[at + n - part + 1] - run[at] == n - part + 1
    return prints[whole], at[whole]


def _with_pieces(batch):
    languages = batch.column("lang").dictionary_encode()
    seeds = np.array([_seed(x) for x in languages.dictionary.to_pylist()], dtype=np.uint64)
    of = languages.indices.to_numpy(zero_copy_only=False)
    for first, block in blocks(batch.column("text"), lower=True):
        numbers = of[first:first + block.n]
        yield Pieces(block, seeds[numbers]), languages.dictionary, numbers


def _counted(texts: DataFrame, sizes: tuple[int, ...], part: int | None, marks: np.ndarray | None) -> DataFrame:
    """(print, n) of the n-grams of these sizes, those of runs that are marked."""
    def run(batches):
        held, entries = [], 0

        def flush():
            prints, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([c for _, c in held]), minlength=len(prints))
            return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(counts.astype(np.int64))], ["print", "n"])

        for batch in batches:
            for pieces, _, _ in _with_pieces(batch):
                for n in sizes:
                    prints = (pieces.fingerprints(n) if part is None else _survivors(pieces, marks, n, part))[0]
                    if len(prints):
                        held.append(np.unique(prints, return_counts=True))
                        entries += len(held[-1][0])
                if entries >= FLUSH_ENTRIES:
                    yield flush()
                    held, entries = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))


def _mark(counted: DataFrame, least: int, marks: np.ndarray) -> np.ndarray:
    """Adds the bits of fingerprints counted `least` times; the driver gets set bits only, MARK_BITS at most."""
    frequent = counted.filter(F.col("n") >= least)
    place = F.explode(F.array(*[F.shiftrightunsigned("print", s).bitwiseAND(F.lit(MARK_BITS - 1)) for s in PLACES]))
    bits = (frequent.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    words = np.zeros(MARK_BITS // 64, dtype=np.int64)
    words[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return marks | words.view(np.uint8)


def _exact_words(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal only where the bytes and the language are; and an occurrence of every number."""
    _, first, number = np.unique(pieces.words, return_index=True, return_inverse=True)
    starts, lengths, data = pieces.starts, pieces.ends - pieces.starts, pieces.block.data
    twin = first[number]
    same = (lengths == lengths[twin]) & (pieces.seeds == pieces.seeds[twin])
    check = np.flatnonzero(same & (twin != np.arange(len(twin))))
    if len(check):
        sizes = lengths[check]
        until = np.cumsum(sizes)
        steps = np.arange(until[-1]) - np.repeat(until - sizes, sizes)
        equal = data[np.repeat(starts[check], sizes) + steps] == data[np.repeat(starts[twin[check]], sizes) + steps]
        same[check] = np.logical_and.reduceat(equal, until - sizes)
    known: dict[tuple, int] = {}
    for i in np.flatnonzero(~same):  # words that only share a hash
        word = data[starts[i]:starts[i] + lengths[i]].tobytes(), pieces.seeds[i]
        if word not in known:
            known[word] = len(first)
            first = np.append(first, i)
        number[i] = known[word]
    return number, first


def _joined(pieces: Pieces, at: np.ndarray, n: int) -> pa.Array:
    """Text of the n words from each place on, one space between words."""
    words = (at[:, None] + np.arange(n)).ravel()
    sizes = pieces.ends[words] - pieces.starts[words] + 1
    until = np.cumsum(sizes)
    steps = np.arange(until[-1]) - np.repeat(until - sizes, sizes)
    last = steps == np.repeat(sizes, sizes) - 1
    data = pieces.block.data[np.minimum(np.repeat(pieces.starts[words], sizes) + steps, len(pieces.block.data) - 1)]
    data[last] = 32
    drop = np.zeros(len(data), dtype=bool)
    drop[until[n - 1::n] - 1] = True
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, np.arange(0, len(sizes), n)) - 1)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[~drop]))


def _materialised(texts: DataFrame, marks: np.ndarray, longest: int) -> DataFrame:
    """(lang, size, phrase, n) of what is marked, told apart by its words; size 0 counts all words of a language."""
    def run(batches):
        for batch in batches:
            for pieces, languages, numbers in _with_pieces(batch):
                if not len(pieces.words):
                    continue
                lang = numbers[pieces.of]
                word, _ = _exact_words(pieces)
                found = [(0, np.unique(lang), None, np.bincount(lang)[np.unique(lang)])]
                code, many = word, int(word.max()) + 1
                for n in range(1, longest + 1):
                    # equal codes, equal words: the code of n words is that of the first n - 1 with the last word's
                    if n > 1:
                        code = np.unique(code[:-1] * np.int64(many) + word[n - 1:], return_inverse=True)[1]
                    prints, at = pieces.fingerprints(n)
                    at = at[marked(marks, prints)]
                    if not len(at):
                        continue
                    _, pointer, times = np.unique(code[at], return_index=True, return_counts=True)
                    found.append((n, lang[at[pointer]], at[pointer], times))
                for n, of, at, times in found:
                    phrase = pa.nulls(len(of), pa.large_string()) if at is None else _joined(pieces, at, n)
                    yield pa.RecordBatch.from_arrays([languages.take(pa.array(of)).cast(pa.string()), pa.array(np.full(len(of), n, dtype=np.int32)),
                                                      phrase.cast(pa.string()), pa.array(times.astype(np.int64))], ["lang", "size", "phrase", "n"])

    return (texts.mapInArrow(run, "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")))


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, n): every phrase of 1 to `longest` words with `least` occurrences, and as size 0 the words of each language.

    Stored. A null text is empty, a null language is `und`; rows without words count nothing, repeated rows count each
    time, other columns are not looked at; an empty table gives none. A phrase lies within a piece of text between the
    marks . , ; : ! ? and line breaks. A task holds some megabytes of text, or the longest single text.
    """
    texts = df.select(F.coalesce(quoted(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), quoted(text).alias("text"))
    marks = np.zeros(MARK_BITS // 8, dtype=np.uint8)
    marks = _mark(_counted(texts, (1,), None, None), least, marks)
    if longest > 1:
        marks = _mark(_counted(texts, (2,), 1, marks), least, marks)
    if longest > 2:
        marks = _mark(_counted(texts, tuple(range(3, longest + 1)), 2, marks), least, marks)
    return stored(_materialised(texts, marks, longest).filter((F.col("size") == 0) | (F.col("n") >= least)), "phrases")


def _cut(candidates: DataFrame) -> DataFrame:
    """A row for each way to cut a candidate in two: after its first k words."""
    words = F.split("phrase", " ")
    return candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, longest: int = LONGEST,
                 top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The `top` phrases of each language by how much more often their parts stand together than apart.

    lang, rank, phrase, a (its count), l and r (counts of the two parts of its lowest-scoring cut, the shortest first
    part on a tie), n (words of the language) and score = floor(1000 a n / (l r)), exact. A phrase that is part of a longer
    one with at least `absorbed` per cent of its count is left out. Order: score and a falling, phrase by bytes. For nulls, empty
    texts, repeated rows and other columns see `frequent_phrases`.
    """
    phrases = frequent_phrases(df, text, lang, least, longest)
    candidates = phrases.filter("size > 1").withColumnRenamed("n", "a")
    parts = small_or_not(phrases.filter(f"size between 1 and {longest - 1}").select("lang", "phrase", "n"))
    cuts = (_cut(candidates)
            .join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
            .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]))
    total = small_or_not(phrases.filter("size = 0").select("lang", "n"))
    wide = [f"cast({c} as decimal(38,0))" for c in "anlr"]
    score = F.expr(f"(cast(1000 as decimal(38,0)) * {wide[0]} * {wide[1]}) div ({wide[2]} * {wide[3]})")
    lowest = (cuts.join(total, "lang").select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "n", "cut.*"))

    words = F.split("phrase", " ")
    inner = (candidates.filter("size > 2").select("lang", "a", "size", words.alias("words"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
             .select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
             .groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer")))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(F.expr(f"longer is null or 100 * cast(longer as decimal(38,0)) < {absorbed} * cast(a as decimal(38,0))"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
