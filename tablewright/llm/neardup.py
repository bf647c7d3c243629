"""Near-duplicate documents by MinHash, with links confirmed on whole shingle sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.session import BROADCAST_ROWS
from tablewright.llm.components import components
from tablewright.llm.frames import in_batches, one_row_per_key, quoted, small_or_not, stored
from tablewright.llm.textblocks import ODD, Block, blocks, grams, mix

BANDS, ROWS = 40, 6
# A pair whose signatures agree in this much less than the threshold is not compared; over five standard errors.
SLACK = 0.13
# Rows of one pivot that a task of the comparison takes.
SALT_ROWS = 500
MEASURED = ["a", "b", "linked", "distance", "least", "total", "only"]
MEASURED_KINDS = "a long, b long, linked boolean, distance double, least long, total long, only array<long>"
# Documents farther from their pivot than FAR get another one, with those that could be linked to them.
FAR = 0.4
# Pivots a document can have before what is left open is joined on whole sets.
ROUNDS = 2


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and their text numbers, ordered by text.

    A text with fewer words than `size` has its whole sequence as one shingle.
    """
    starts, ends, of = block.words()
    words = block.hashes(starts, ends)
    hashes, at = grams(words, of, size)
    texts = of[at]
    count = np.bincount(of, minlength=block.n) if len(of) else np.zeros(block.n, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for short in range(1, size):
        those = np.flatnonzero(count == short)
        if len(those):
            rolling = np.zeros(len(those), dtype=np.uint64)
            for i in range(short):
                rolling = rolling * ODD + words[first[those] + i]
            hashes, texts = np.concatenate([hashes, mix(rolling + np.uint64(short))]), np.concatenate([texts, those])
    keys = mix(hashes ^ (texts.astype(np.uint64) * ODD))
    _, once = np.unique(keys, return_index=True)
    once = once[np.argsort(texts[once], kind="stable")]
    return hashes[once], texts[once]


def signatures(df: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """key, n_shingles, two order-free hashes of the set, `bands` band hashes and one byte for each minimum."""
    random = np.random.default_rng(4099)
    factors = random.integers(1, 1 << 31, size=bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = random.integers(0, 1 << 32, size=bands * rows, dtype=np.uint32)

    def sketch(block):
        hashes, texts = shingles(block, size)
        n = np.bincount(texts, minlength=block.n) if len(texts) else np.zeros(block.n, dtype=np.int64)
        filled = np.flatnonzero(n)
        first = np.concatenate([[0], np.cumsum(n[filled])[:-1]]).astype(np.int64)
        s1, s2 = np.zeros(block.n, dtype=np.uint64), np.zeros(block.n, dtype=np.uint64)
        minima = np.zeros((len(filled), bands * rows), dtype=np.uint32)
        if len(filled):
            s1[filled] = np.add.reduceat(mix(hashes), first)
            s2[filled] = np.add.reduceat(mix(hashes ^ ODD), first)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            for i in range(bands * rows):
                minima[:, i] = np.minimum.reduceat(short * factors[i] + shifts[i], first)
        keys = np.zeros((len(filled), bands), dtype=np.uint64)
        for r in range(rows):
            keys = mix(keys * ODD + minima[:, r::rows])
        keys = mix(keys + np.arange(bands, dtype=np.uint64) * ODD)
        marks = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        return n, s1, s2, filled, keys, marks

    def run(batches):
        for batch in batches:
            for first, block in blocks(batch.column(1), lower=True):
                n, s1, s2, filled, keys, marks = sketch(block)
                sizes = np.zeros(block.n, dtype=np.int64)
                sizes[filled] = 1
                ends = np.concatenate([[0], np.cumsum(sizes)])
                band_list = pa.ListArray.from_arrays(pa.array((ends * bands).astype(np.int32)), pa.array(keys.view(np.int64).ravel()))
                mark_list = pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer((ends * bands * rows).astype(np.int32)), pa.py_buffer(marks.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, block.n), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), band_list, mark_list],
                    ["key", "n_shingles", "s1", "s2", "bands", "marks"])

    return in_batches(df, run, "key long, n_shingles long, s1 long, s2 long, bands array<long>, marks binary")


def _agreeing(pairs: DataFrame, marks: DataFrame, hashes: int, percent: int) -> DataFrame:
    """Signature verification: pairs (a, b) whose sizes allow the threshold and whose minima agree often enough."""
    first = marks.select(F.col("key").alias("a"), F.col("n_shingles").alias("na"), F.col("marks").alias("ma"))
    second = marks.select(F.col("key").alias("b"), F.col("n_shingles").alias("nb"), F.col("marks").alias("mb"))
    sided = (first.join(small_or_not(pairs), "a").join(second, "b")
             .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    needed = (percent / 100 - SLACK) * hashes

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ma, mb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, hashes) for c in ("ma", "mb"))
            near = (ma == mb).sum(axis=1) >= needed
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return in_batches(sided.select("a", "b", "ma", "mb"), run, "a long, b long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a stored table with both texts, ordered by b; a frequent b is spread over several tasks."""
    salts = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts")), "salts", pairs.count())
    salts = small_or_not(salts)
    salted = pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    if pairs.count() <= BROADCAST_ROWS:
        salted = F.broadcast(salted)
    pivots = (texts.select(F.col("key").alias("b"), F.col("text").alias("tb")).join(salts, "b")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    return (texts.select(F.col("key").alias("a"), F.col("text").alias("ta")).join(salted, "a")
            .join(pivots.select("b", "salt", "tb"), ["b", "salt"]).select("a", "b", "ta", "tb"))


def _sets_of(batch, size: int):
    """(row, set of a, sorted set of b, places of a's shingles in b) of every row of a batch."""
    def whole(column):
        for _, block in blocks(column, lower=True):
            hashes, of = shingles(block, size)
            ends = np.cumsum(np.bincount(of, minlength=block.n)) if len(of) else np.zeros(block.n, dtype=np.int64)
            yield from np.split(hashes, ends[:-1])

    b = batch.column("b").to_numpy()
    fresh = np.ones(len(b), dtype=bool)
    fresh[1:] = b[1:] != b[:-1]
    pivots, pivot = whole(batch.column("tb").filter(pa.array(fresh))), None
    for i, own in enumerate(whole(batch.column("ta"))):
        if fresh[i]:
            pivot = np.sort(next(pivots))
        yield i, own, pivot, np.minimum(np.searchsorted(pivot, own), max(0, len(pivot) - 1))


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets reach the threshold."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, own, other, place in _sets_of(batch, size):
                common = int((other[place] == own).sum())
                keep[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return in_batches(_with_texts(pairs, texts), run, "a long, b long")


def _measured(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Each document a against its pivot b: linked, distance, and how many shingles only one has; within FAR also
    which (by 64-bit hash), and how many of them any link of a has to share with the other document's (`least`).

    With c the pivot and D(x) the shingles in only one of x and c, x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)|
    shingles, and are linked when that is at most r (|x| + |y|) for r = (1 - s) / (1 + s). As |y| <= |x| / s, a link
    shares at least |D(x)| - r (1 + 1 / s) |x| of D(x). If y is not linked to c, it shares more than (1 - r) |D(x)| / 2.
    """
    s = percent / 100
    r = (1 - s) / (1 + s)

    def run(batches):
        for batch in batches:
            linked, distance, least, total, tokens, ends = [], [], [], [], [], [0]
            for _, own, other, place in _sets_of(batch, size):
                shared = other[place] == own
                common = int(shared.sum())
                union = len(own) + len(other) - common
                linked.append(100 * common >= percent * union)
                distance.append(1 - common / union)
                bound, extra = 1, 0
                if distance[-1] <= FAR:
                    missing = np.ones(len(other), dtype=bool)
                    missing[place[shared]] = False
                    only = np.concatenate([own[~shared], other[missing]])
                    tokens.append(only)
                    extra = len(only)
                    bound = max(1, int(np.ceil(extra - r * (1 + 1 / s) * len(own) - 1e-6)))
                    if linked[-1]:
                        bound = max(bound, int(np.ceil((1 - r) * extra / 2 - 1e-6)))
                ends.append(ends[-1] + extra)
                least.append(bound)
                total.append(len(own))
            values = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64()), pa.array(least, pa.int64()), pa.array(total, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], MEASURED)

    return in_batches(_with_texts(pairs, texts), run, MEASURED_KINDS)


def _unmeasured(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The same columns for documents without a pivot (as if it were empty): b is their group, `only` the whole set."""
    s = percent / 100
    r = (1 - s) / (1 + s)

    def run(batches):
        for batch in batches:
            for first, block in blocks(batch.column("text"), lower=True):
                hashes, of = shingles(block, size)
                n = np.bincount(of, minlength=block.n) if len(of) else np.zeros(block.n, dtype=np.int64)
                least = np.maximum(1, np.ceil(n - r * (1 + 1 / s) * n - 1e-6)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                part = batch.slice(first, block.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(np.zeros(block.n, dtype=bool)), pa.array(np.zeros(block.n)), pa.array(least), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))], MEASURED)

    return in_batches(members.join(texts.withColumnRenamed("key", "a"), "a").select("a", "b", "text"), run, MEASURED_KINDS)


def _differing_alike(measured: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with one pivot, not both linked to it, that may be linked: they share one of the rarest of the
    shingles by which they differ from the pivot, so early that enough can follow (a prefix and a position filter)."""
    near = measured.filter("distance <= %s" % FAR)
    open_pivots = near.groupBy("b").agg(
        F.count("*").alias("n"), F.sum((~F.col("linked")).cast("int")).alias("free")).filter("n > 1 and free > 0").select("b")
    members = near.join(open_pivots, "b").withColumn("size", F.size("only"))
    members = stored(members, "members")
    tokens = members.select("a", "b", F.explode("only").alias("token"))
    often = tokens.groupBy("b", "token").agg(F.count("*").alias("n")).filter("n > 1")
    common = tokens.join(often, ["b", "token"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("common"))
    single = F.col("size") - F.size("common")
    room = F.col("size") - F.col("least") + 1 - single
    prefix = (members.drop("only").join(common, ["a", "b"]).withColumn("single", single).withColumn("room", room).filter("room > 0")
              .select("a", "b", "linked", "size", "total", "single", F.posexplode(F.slice("common", F.lit(1), F.col("room"))).alias("place", "t"))
              .select("a", "b", "linked", "total", "size", F.col("t.token").alias("token"), (F.col("size") - F.col("single") - F.col("place")).alias("rest")))
    prefix = stored(prefix, "prefixes")
    x = prefix.filter("not linked").select("b", "token", F.col("a").alias("x"), F.col("size").alias("sx"), F.col("total").alias("tx"), F.col("rest").alias("rx"))
    y = prefix.select("b", "token", F.col("a").alias("y"), "linked", "size", "total", "rest")
    r = (1 - percent / 100) / (1 + percent / 100)
    enough = 2 * F.least("rx", "rest") >= F.col("sx") + F.col("size") - r * (F.col("tx") + F.col("total")) - 1e-6
    pairs = x.join(y, ["b", "token"]).filter((F.col("linked") | (F.col("x") > F.col("y"))) & enough)
    return stored(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "alike")


def _groups(entries: DataFrame) -> DataFrame:
    """(node, component) of the documents that hang together by buckets."""
    centres = entries.groupBy("bucket").agg(F.min("key").alias("centre"))
    return components(entries.join(centres, "bucket").filter("key <> centre").select("key", "centre").distinct(), "key", "centre")


def _pivots(entries: DataFrame) -> DataFrame:
    """(a, b): every document of a group that hangs together by buckets, and the one whose buckets hold most."""
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"))
    weights = entries.join(sizes, "bucket").groupBy("key").agg(F.sum("n").alias("weight")).withColumnRenamed("key", "a")
    members = stored(_groups(entries).select(F.col("node").alias("a"), "component").join(weights, "a"), "groups")
    chosen = members.groupBy("component").agg((-F.max(F.struct("weight", (-F.col("a")).alias("a")))["a"]).alias("b"))
    return members.join(chosen, "component").filter("a <> b").select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Key, n_shingles, component_id (smallest key reachable by links) and kept (key = component_id) per document.

    Two documents are linked when their sets of `shingle`-word shingles (words without ASCII white space, A-Z
    lower-cased) have a Jaccard similarity of at least `percent` / 100. Equal sets are represented by their
    smallest key. Candidates share one of `bands` keys of `rows` MinHash values; a pair at the threshold is
    missed with probability (1 - s ** rows) ** bands, 5e-6 at 0.8 and 1e-10 at 0.85. Each candidate is first
    judged by its signatures, then on the whole sets.

    Large groups: all documents that hang together by shared buckets are compared with one pivot, the one that
    shares most. Only those that it doesn't link are compared further, with documents that differ from the pivot
    in the same shingles; a prefix filter on the rarest of these loses no link. Documents far from the pivot get
    another one; what is open after ROUNDS pivots goes through the same filter with its whole sets.

    A null or empty text has no shingles and its own component. Rows with a null key come back with a null
    component and kept true. Rows that repeat a key are one document with the smallest text. Keys are whole
    numbers. An empty table gives an empty result. Memory of a task follows the longest text.
    """
    documents = one_row_per_key(df.select(quoted(key).cast("long").alias("key"), quoted(text).alias("text")))
    signed = stored(signatures(documents, shingle, bands, rows), "signatures")
    sets = signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    sets = stored(sets, "sets")
    reps = signed.join(sets.select(F.col("rep").alias("key")), "key", "left_semi")
    marks = reps.select("key", "n_shingles", "marks")

    entries = reps.select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    entries = stored(entries.join(shared.select("bucket"), "bucket"), "buckets")
    texts = stored(documents.join(entries.select("key").distinct(), "key", "left_semi"), "texts")
    agree = bands * rows

    links = []
    for _ in range(ROUNDS):
        if entries.isEmpty():
            break
        pivots = stored(_pivots(entries), "pivots")
        measured = stored(_measured(pivots, texts, shingle, percent), "measured")
        alike = stored(_agreeing(_differing_alike(measured, percent), marks, agree, percent), "agreeing")
        links += [measured.filter("linked").select("a", "b"), stored(_confirmed(alike, texts, shingle, percent), "links")]
        reach = measured.filter(f"distance > {FAR - (1 - percent / 100) - 1e-9}").select(F.col("a").alias("key"), (F.col("distance") > FAR).alias("far"))
        left = entries.join(reach, "key")
        wanted = left.groupBy("bucket").agg(F.count("*").alias("n"), F.max("far").alias("far")).filter("n > 1 and far").select("bucket")
        entries = stored(left.select("key", "bucket").join(wanted, "bucket"), "buckets")
    groups = _groups(entries).select(F.col("node").alias("a"), F.col("component").alias("b"))
    alike = _differing_alike(_unmeasured(groups, texts, shingle, percent), percent)
    links.append(_confirmed(stored(_agreeing(alike, marks, agree, percent), "agreeing"), texts, shingle, percent))
    found = components(reduce(DataFrame.unionByName, links), "a", "b")

    classes = (sets.join(found.withColumnRenamed("node", "rep"), "rep", "left")
               .select("s1", "s2", F.coalesce("component", "rep").alias("component")))
    out = (signed.select("key", "n_shingles", "s1", "s2")
           .join(classes, ["s1", "s2"], "left")
           .select("key", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("key").isNotNull(), F.col("component")).otherwise(F.col("key")).alias("component_id"))
           .withColumn("kept", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True))))
    return out.withColumnRenamed("key", key)


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose document is kept, one for each key; rows with a null key stay."""
    kept = near_duplicates(df, key, text, **options).filter(F.col("kept") & quoted(key).isNotNull()).select(quoted(key).alias("key"))
    unique = one_row_per_key(df.select(quoted(key).alias("key"), F.struct(*map(quoted, df.columns)).alias("row")))
    return unique.join(kept, "key", "left_semi").unionByName(unique.filter("key is null")).select("row.*")
