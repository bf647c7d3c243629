"""SentencePiece encoding and decoding by matching the whole vocabulary against a suffix array."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame

from tablewright.llm.frames import in_batches, quoted

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Characters of texts and of unseen segments that are indexed together, and segments whose pieces are remembered.
BATCH_CHARS, INDEX_CHARS, REMEMBERED = 1 << 20, 1 << 18, 100_000
# Longer segments are merged one by one.
LONG = 48
NEVER = np.int32(2**31 - 1)


class Vocabulary:
    """Pieces of a byte-pair model: code point matrix, merge order, byte pieces."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto
        parsed = proto.ModelProto()
        parsed.ParseFromString(model)
        if parsed.trainer_spec.model_type != parsed.trainer_spec.BPE or parsed.normalizer_spec.precompiled_charsmap:
            raise ValueError("only byte-pair models without character normalisation are supported")
        if parsed.normalizer_spec.remove_extra_whitespaces or not parsed.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that keep white space and begin a text with a space are supported")
        kinds = [p.type for p in parsed.pieces]
        names = [p.piece for p in parsed.pieces]
        self.normal = np.array([i for i, k in enumerate(kinds) if k == 1], dtype=np.int32)
        words = [names[i] for i in self.normal]
        self.longest = max(map(len, words))
        self.alphabet = sorted(set("".join(words)))
        code = {c: i + 1 for i, c in enumerate(self.alphabet)}
        self.code_of = np.zeros(0x110000, dtype=np.int32)
        self.code_of[[ord(c) for c in self.alphabet]] = np.arange(1, len(self.alphabet) + 1)
        self.matrix = np.zeros((len(words), self.longest), dtype=np.int32)
        for row, word in enumerate(words):
            self.matrix[row, :len(word)] = [code[c] for c in word]
        self.lengths = np.array([len(w) for w in words])
        # merges of higher score come first, equal ones from the left
        scores = np.array([parsed.pieces[i].score for i in self.normal])
        self.rank = np.full(len(names), NEVER, dtype=np.int32)
        self.rank[self.normal] = np.searchsorted(np.sort(-scores), -scores, "left")
        self.unknown = next(i for i, k in enumerate(kinds) if k == 2)
        named = {n: i for i, (n, k) in enumerate(zip(names, kinds)) if k == 6}
        self.bytes = [named.get(f"<0x{b:02X}>", self.unknown) for b in range(256)] if named else None
        spelled = [b""] * len(names)
        for i, k in enumerate(kinds):
            if k == 6:
                spelled[i] = bytes([int(names[i][3:5], 16)])
            elif k == 1:
                spelled[i] = names[i].replace(SPACE, " ").encode()
        spelled[self.unknown] = " ⁇ ".encode()
        self.letters = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in spelled], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        # a text falls apart where no piece reaches across: before a space sign, around line breaks without a piece
        if any(SPACE in w.lstrip(SPACE) for w in words):
            raise ValueError("a piece has a space sign after another character")
        alone = re.escape("".join(c for c in "\n\r\t" if not self.code_of[ord(c)]))
        self.segments = re.compile((f"[{alone}]|" if alone else "") + f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+").findall

    def spell(self, character: str) -> list[int]:
        """Ids of a character without a piece."""
        return [self.bytes[b] for b in character.encode()] if self.bytes else [self.unknown]


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _edges(codes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """By length and position, the piece that lies there (or -1).

    The suffixes of the text are sorted by as many characters as fit into a 64-bit key; each piece is looked up by
    binary search, which gives the range of suffixes that begin with it. For a piece that is longer than a key, the
    range of its beginning is narrowed to the suffixes that go on like it.
    """
    n, longest = len(codes), vocab.longest
    table = np.full((longest + 1, n + 1), -1, dtype=np.int32)
    used = np.unique(codes)
    used = used[used > 0]
    if not len(used):
        return table
    dense = np.zeros(len(vocab.alphabet) + 1, dtype=np.uint64)
    dense[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    per_key = min(longest, 63 // bits)
    text = np.concatenate([dense[codes], np.zeros(longest + per_key, dtype=np.uint64)])
    rows = np.flatnonzero(((dense[vocab.matrix] > 0).sum(axis=1)) == vocab.lengths)
    pieces = dense[vocab.matrix[rows]]
    pieces = np.concatenate([pieces, np.zeros((len(rows), per_key), dtype=np.uint64)], axis=1)
    lengths, ids = vocab.lengths[rows], vocab.normal[rows]

    key, low, high = np.zeros(n, dtype=np.uint64), np.zeros(len(rows), dtype=np.uint64), np.zeros(len(rows), dtype=np.uint64)
    for j in range(per_key):
        key = (key << np.uint64(bits)) | text[j:j + n]
        low = (low << np.uint64(bits)) | pieces[:, j]
        high = (high << np.uint64(bits)) | np.where(j < lengths, pieces[:, j], np.uint64((1 << bits) - 1))
    suffixes = np.argsort(key)
    key = key[suffixes]
    begin = np.searchsorted(key, low, "left")
    end = np.searchsorted(key, high, "right")
    for row in np.flatnonzero((lengths > per_key) & (end > begin)):
        at = suffixes[begin[row]:end[row]]
        for j in range(per_key, int(lengths[row])):
            at = at[text[at + j] == pieces[row, j]]
        table[lengths[row], at] = ids[row]
        end[row] = begin[row]
    count = np.maximum(0, end - begin)
    found = np.repeat(np.arange(len(rows)), count)
    within = np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count)
    # edges in order of position, which is their address
    table[lengths[found], suffixes[begin[found] + within]] = ids[found]
    return table


def _merge_long(table, rank, first, last, longest):
    """Pieces of one long segment: the best pair is merged, from the left among equals, by a heap."""
    following, before = list(range(1, last - first + 1)), list(range(-1, last - first - 1))
    size = last - first
    until = list(range(1, size + 1))
    heap = []

    def offer(i):
        j = following[i]
        if j < size and until[j] - i <= longest:
            piece = table[until[j] - i, first + i]
            if piece >= 0:
                heapq.heappush(heap, (int(rank[piece]), i, until[i], until[j]))

    for i in range(size):
        offer(i)
    alive = [True] * size
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if not alive[i] or until[i] != middle or following[i] >= size or until[following[i]] != end:
            continue
        j = following[i]
        alive[j] = False
        until[i], following[i] = end, following[j]
        if following[i] < size:
            before[following[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(first + i, first + until[i]) for i in range(size) if alive[i]]


def _relax(table: np.ndarray, rank: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the pieces of all segments: in each round every segment joins its best two neighbours that an edge
    spans, until none does."""
    short = np.flatnonzero(lasts - firsts <= LONG)
    done = [_merge_long(table, rank, int(firsts[i]), int(lasts[i]), longest) for i in np.flatnonzero(lasts - firsts > LONG)]
    starts = [np.array([a for part in done for a, _ in part], dtype=np.int64)]
    ends = [np.array([b for part in done for _, b in part], dtype=np.int64)]
    sizes = (lasts - firsts)[short]
    of = np.repeat(np.arange(len(short)), sizes)
    st = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(firsts[short], sizes)
    en = st + 1
    while len(st):
        length = en[1:] - st[:-1]
        fits = (of[1:] == of[:-1]) & (length <= longest)
        piece = table[np.where(fits, length, 0), st[:-1]]
        order = np.full(len(st), NEVER, dtype=np.int32)
        order[:-1] = np.where(piece >= 0, rank[piece], NEVER)
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        best = np.minimum.reduceat(order, heads)
        best = np.repeat(best, np.diff(np.append(heads, len(st))))
        at = np.flatnonzero((order == best) & (best < NEVER))
        if len(at):
            at = at[np.concatenate([[True], of[at[1:]] != of[at[:-1]]])]
        finished = best == NEVER
        starts.append(st[finished])
        ends.append(en[finished])
        en[at] = en[at + 1]
        stay = ~finished
        stay[at + 1] = False
        st, en, of = st[stay], en[stay], of[stay]
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    by_place = np.argsort(starts)
    return starts[by_place], ends[by_place]


def encode_segments(segments: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments one after the other, and how many each has."""
    flats, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    first = 0
    while first < len(segments):
        last, size = first, 0
        while last < len(segments) and (last == first or size + len(segments[last]) < INDEX_CHARS):
            size += len(segments[last]) + 1
            last += 1
        part = segments[first:last]
        points = np.frombuffer("\0".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        firsts = np.cumsum(sizes + 1) - sizes - 1
        table = _edges(vocab.code_of[points], vocab)
        starts, ends = _relax(table, vocab.rank, firsts, firsts + sizes, vocab.longest)
        ids = table[ends - starts, starts]
        plain = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), dtype=np.int64)
        spelt = [vocab.spell(chr(points[starts[i]])) for i in plain]
        count[plain] = [len(s) for s in spelt]
        flat = np.repeat(ids, count)
        place = np.concatenate([[0], np.cumsum(count)])
        for i, spelling in zip(plain, spelt):
            flat[place[i]:place[i] + len(spelling)] = spelling
        flats.append(flat)
        counts.append(np.diff(np.append(place[np.searchsorted(starts, firsts, "left")], len(flat))))
        first = last
    return np.concatenate(flats), np.concatenate(counts)


def decode_rows(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[str]:
    """Texts of rows of ids that stand one after the other."""
    known = (ids >= 0) & (ids < len(vocab.sizes))
    size = np.where(known, vocab.sizes[np.where(known, ids, 0)], 0)
    done = np.cumsum(size)
    first = vocab.places[np.where(known, ids, 0)]
    raw = vocab.letters[np.arange(int(size.sum())) + np.repeat(first - done + size, size)].tobytes()
    ends = np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(counts)])]
    return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class _Numbers(dict):
    """Numbers segments as they first appear."""

    def __missing__(self, segment):
        self[segment] = number = len(self)
        return number


class Encoder:
    """Encodes texts; the pieces of segments seen before are remembered."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.forget()

    def forget(self):
        self.numbers = _Numbers()
        self.flat, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        seen, segments = len(self.numbers), self.vocab.segments
        split = [segments(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts]
        parts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        used = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(parts.sum()))
        flat, counts = encode_segments(list(islice(self.numbers, seen, None)), self.vocab)
        self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts])
        first = np.cumsum(self.counts) - self.counts
        size = self.counts[used]
        done = np.cumsum(size)
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(first[used] - done + size, size)]
        total = np.concatenate([[0], done])[np.concatenate([[0], np.cumsum(parts)])]
        return ids, np.diff(total)


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    """Kept by a worker from task to task."""
    return Encoder(vocabulary(model))


def _slices(batch, column: int):
    """Parts of a batch with about BATCH_CHARS of text, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(size):
        start = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, start + BATCH_CHARS, "right")))
        yield batch.slice(first, last - first)
        first = last


def _kinds(df: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f"k{i} {df.select(quoted(c)).schema[0].dataType.simpleString()}, " for i, c in enumerate(columns))


def _shared(df: DataFrame, path: str):
    """The vocabulary file (under a megabyte) for all executors; only the driver needs its path."""
    with open(path, "rb") as file:
        return SparkContext.getOrCreate().broadcast(file.read())


def encode_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY,
                 check: bool = False) -> DataFrame:
    """The `keep` columns, ids (array of int) and n_tokens of every text, as the vocabulary's own encoder gives them;
    with `check` also round_trip: whether the ids decode to the text (U+2581 as a space).

    All pieces that occur in a batch of texts are found by binary search in its suffix array and become edges by
    position; neighbours are then joined along the edges in the vocabulary's order of merges. Texts are cut where
    no piece can reach across, and each distinct segment of a batch is indexed once. Characters without a piece
    become byte pieces. A null or empty text has no ids; rows stay as they are. Memory follows the longest text.
    """
    model, n = _shared(df, path), len(keep)

    def run(batches):
        encoder = _encoder(model.value)
        for batch in batches:
            for part in _slices(batch, n):
                texts = part.column(n).to_pylist()
                ids, counts = encoder.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [*(part.column(i) for i in range(n)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())), pa.array(counts)]
                if check:
                    columns.append(pa.array([new == (old or "").replace(SPACE, " ") for new, old in zip(decode_rows(ids, counts, encoder.vocab), texts)]))
                yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(n)), "ids", "n_tokens", *(["round_trip"] if check else [])])
        encoder.forget()

    chosen = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(text).alias("text"))
    out = in_batches(chosen, run, _kinds(df, keep) + "ids array<int>, n_tokens long" + ", round_trip boolean" * check)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def decode_ids(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str = VOCABULARY) -> DataFrame:
    """The `keep` columns and decoded: the text of an array of ids.

    A text comes back as it was, but for U+2581, the vocabulary's space sign, which becomes a space. Null or empty
    ids give an empty text, ids outside the vocabulary and control pieces give nothing, bytes that are no UTF-8 U+FFFD.
    """
    model, n = _shared(df, path), len(keep)

    def run(batches):
        vocab = vocabulary(model.value)
        for batch in batches:
            rows = batch.column(n).fill_null([])
            counts = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
            texts = decode_rows(pc.fill_null(rows.flatten(), -1).to_numpy(zero_copy_only=False), counts, vocab)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(texts, pa.string())], [*(f"k{i}" for i in range(n)), "decoded"])

    chosen = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)], quoted(ids).cast("array<int>").alias("ids"))
    out = in_batches(chosen, run, _kinds(df, keep) + "decoded string")
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
