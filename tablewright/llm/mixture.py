"""Mixing sources to target weights: block quotas split over shards by multivariate hypergeometric draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.frames import let, one_row_per_key, quoted, small_or_not, stored

WORD = r"[^\x20\x09-\x0D]+"
# Words in a block; blocks of a source are ordered by 60-bit hashes, first by their 12 high bits.
BLOCK_WORDS, LOW_BITS = 512, 48
WEIGHTS, SHARE, MOST_PASSES, SHARDS = (3, 1, 2), 1.5, 2, 16
# Copies of a row that a task numbers at once, and rows of a shard that are shuffled together.
COPIES, SLICE_ROWS = 10_000, 100_000


def _doc(key: Column, source: Column, text: Column) -> Column:
    """Digest of a row's key, source and text; null is a key and a source of its own, and the empty text."""
    named = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (key, source)]
    return F.md5(F.concat_ws("\x01", *named, F.coalesce(text, F.lit(""))))


def sized_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size (words of the text), doc and copy of every row.

    Every row is a document, whatever its key. `doc` is a digest of key, source and text, `copy` counts the rows that
    agree in all three from 0. Copies are counted before they are numbered, in steps of COPIES.
    """
    size = F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = df.select(quoted(key).alias("key"), quoted(source).alias("source"), size.alias("size"), _doc(quoted(key), quoted(source), quoted(text)).alias("doc"))
    least = F.min(F.struct("key", "source", "size")).alias("row")
    counted = stored(sized.groupBy("doc").agg(least, F.count("*").alias("copies")).select("row.*", "doc", "copies"), "counted")
    if counted.filter("copies > 1").isEmpty():
        return counted.drop("copies").withColumn("copy", F.lit(0).cast("long"))
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("doc", "step")
    copies = F.explode(F.sequence(F.col("step") * COPIES, F.least(F.col("copies"), (F.col("step") + 1) * COPIES) - 1))
    return stored(steps.select("key", "source", "size", "doc", copies.alias("copy")), "sized")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """source, source_size, target: `share` of all words dealt by weight, at most `passes` times a source's words.

    Sources in code point order, null last, take the weights in turn. The excess over a source's limit is dealt to
    the others by weight until none is above: target = min(limit, level * weight), where the level is found in the
    order of limit / weight. The windows run over the table of sources, one row each.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    dealt = (sources.withColumn("weight", turn).withColumn("limit", F.lit(float(passes)) * F.col("source_size"))
             .withColumn("fill", F.col("limit") / F.col("weight")))
    everything = Window.partitionBy()
    rising = Window.orderBy("fill", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    capped, lighter = F.coalesce(F.sum("limit").over(rising), F.lit(0.0)), F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    level = (total - capped) / (F.sum("weight").over(everything) - lighter)
    levels = dealt.withColumn("level", level)
    first = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "level"))).over(everything)
    return (levels.withColumn("level", F.coalesce(first["level"], F.lit(float("inf"))))
            .select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target")))


def ranked_blocks(sized: DataFrame, seed: str = "mix") -> DataFrame:
    """doc, copy, source, block, words, rank and words_before of every block in its source's permuted order.

    The order is by hash. Counts for the high bits of the hash give the offsets of its ranges, a window only ever
    holds one range of one source.
    """
    last = F.ceil(F.col("size") / BLOCK_WORDS).cast("int") - 1
    blocks = sized.filter("size > 0").select("doc", "copy", "source", "size", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    mark = F.md5(F.concat_ws(":", F.lit(seed), "doc", F.col("copy").cast("string"), F.col("block").cast("string")))
    blocks = (blocks.withColumn("hash", F.conv(F.substring(mark, 1, 15), 16, 10).cast("long"))
              .withColumn("words", F.least(F.lit(BLOCK_WORDS), F.col("size") - BLOCK_WORDS * F.col("block")).cast("long"))
              .withColumn("range", F.shiftright("hash", LOW_BITS)))
    blocks = stored(blocks.drop("size"), "blocks")
    ranges = blocks.groupBy("source", "range").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
                            F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    inside = Window.partitionBy("source", "range").orderBy("hash", "doc", "copy", "block")
    placed = (blocks.withColumn("nth", F.row_number().over(inside) - 1)
              .withColumn("inner", F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    same = placed["source"].eqNullSafe(offsets["source"]) & (placed["range"] == offsets["range"])
    return placed.join(offsets, same).select(
        "doc", "copy", placed["source"], "block", "words", "hash", (F.col("n_before") + F.col("nth")).alias("rank"),
        (F.col("w_before") + F.col("inner")).alias("words_before"))


def source_quotas(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """source, n_blocks and quota: the blocks drawn, whole passes and then those whose middle lies before the target."""
    joined = ranked.join(small_or_not(targets.withColumnRenamed("source", "s")), ranked["source"].eqNullSafe(F.col("s")))
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    part = (2 * F.col("words_before") + F.col("words") <= 2 * rest).cast("long")
    return (joined.groupBy("source").agg(F.count("*").alias("n_blocks"), F.sum(part).alias("part"), F.max(passes).alias("passes"))
            .select("source", "n_blocks", (F.col("passes") * F.col("n_blocks") + F.col("part")).cast("long").alias("quota")))


def _drawn(total: Column, good: Column, taken: Column, chance: Column) -> Column:
    """One hypergeometric draw by inversion: how many of `good` among `total` are in `taken`, for a chance in [0, 1).

    The probabilities follow from their ratio, from twelve deviations below the mean to as many above it.
    """
    share = good / F.greatest(total, F.lit(1))
    mean = taken * share
    spread = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * (total - taken) / F.greatest(total - 1, F.lit(1)))) * 12 + 3
    low = F.greatest(F.lit(0), taken + good - total, F.floor(mean - spread)).cast("long")
    high = F.least(taken, good, F.ceil(mean + spread)).cast("long")
    steps = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))

    def following(weight, k):
        return weight * ((good - k).cast("double") * (taken - k)) / ((k + 1).cast("double") * (total - good - taken + k + 1))

    def weights(at, k):
        return F.struct(following(at["weight"], k).alias("weight"), (at["sum"] + following(at["weight"], k)).alias("sum"))

    def passed(at, k, goal):
        return F.struct(following(at["weight"], k).alias("weight"), (at["sum"] + following(at["weight"], k)).alias("sum"),
                        (at["more"] + (at["sum"] <= goal).cast("long")).alias("more"))

    start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"))
    first = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), F.lit(0).cast("long").alias("more"))
    return let(F.struct(low.alias("low"), steps.alias("steps")), lambda range_: let(
        chance * F.aggregate(range_["steps"], start, weights)["sum"],
        lambda goal: range_["low"] + F.aggregate(range_["steps"], first, lambda at, k: passed(at, k, goal))["more"]))


def shard_quotas(quotas: DataFrame, shards: int = SHARDS, seed: str = "mix") -> DataFrame:
    """source, shard, first and until: the range of a source's draws that each shard gets.

    A tree halves the shards; at each node the blocks of the left half are drawn from the node's without regard to
    their source, so the counts by source are one multivariate hypergeometric draw, source after source. Shard
    sizes are exact. A node is a row with one number for each source; blocks are not touched.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda at, x: at + x["n"])
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("null"), "source", F.col("quota").alias("n")))).alias("counts"))
    nodes = nodes.select("counts", F.lit(0).alias("shard"), F.lit(shards).alias("width"))
    while shards > 1:
        shards = (shards + 1) // 2
        half = F.ceil(F.col("width") / 2).cast("int")
        wanted = F.when(F.col("width") > 1, F.floor(total * half / F.col("width"))).otherwise(total).cast("long")
        start = F.struct(total.alias("left"), wanted.alias("open"), F.array().cast("array<long>").alias("drawn"))

        def step(at, x):
            chance = F.pmod(F.xxhash64(F.lit(seed), F.col("shard"), F.col("width"), x["source"]), F.lit(1 << 52)) / float(1 << 52)
            n = _drawn(at["left"], x["n"], at["open"], chance)
            return let(n, lambda k: F.struct(
                (at["left"] - x["n"]).alias("left"), (at["open"] - k).alias("open"), F.concat(at["drawn"], F.array(k)).alias("drawn")))

        split = nodes.select("counts", "shard", "width", half.alias("half"), F.aggregate("counts", start, step)["drawn"].alias("drawn"))
        left = F.zip_with("counts", "drawn", lambda x, k: F.struct(x["null"].alias("null"), x["source"].alias("source"), k.alias("n")))
        right = F.zip_with("counts", "drawn", lambda x, k: F.struct(x["null"].alias("null"), x["source"].alias("source"), (x["n"] - k).alias("n")))
        children = F.array(F.struct(left.alias("counts"), F.col("shard"), F.col("half").alias("width")),
                           F.struct(right.alias("counts"), (F.col("shard") + F.col("half")).alias("shard"), (F.col("width") - F.col("half")).alias("width")))
        nodes = stored(split.select(F.explode(children).alias("c")).select("c.*").filter("width > 0"), "nodes")
    leaves = nodes.select("shard", F.explode("counts").alias("c")).select("c.source", "shard", "c.n")
    by_shard = Window.partitionBy("source").orderBy("shard")
    until = F.sum("n").over(by_shard)
    return leaves.select("source", "shard", (until - F.col("n")).alias("first"), until.alias("until"))


def mixture(sized: DataFrame, targets: DataFrame, shards: int = SHARDS, passes: int = MOST_PASSES, seed: str = "mix") -> DataFrame:
    """doc, copy, source, block, words, pass, shard and spot of every block that is drawn; a block comes once for each pass.

    Draws of a source are disjoint: its blocks in permuted order, pass after pass, in the ranges that the tree gives
    to the shards; what is in no shard's range is not drawn. `spot` is the random order inside a shard.
    """
    ranked = stored(ranked_blocks(sized, seed), "ranked")
    quotas = stored(source_quotas(ranked, targets), "quotas")
    ranges = shard_quotas(quotas, shards, seed).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("first", "until", "shard"))).alias("ranges"))
    sources = stored(quotas.join(ranges.withColumnRenamed("source", "s"), quotas["source"].eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "n_blocks", "ranges"), "sources")
    placed = ranked.join(small_or_not(sources), ranked["source"].eqNullSafe(F.col("s")))
    draws = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "draw", F.col("rank") + F.col("pass") * F.col("n_blocks"))
    shard = F.filter("ranges", lambda x: (x["first"] <= F.col("draw")) & (F.col("draw") < x["until"]))
    return (draws.withColumn("shard", F.get(shard, F.lit(0))["shard"]).filter("shard is not null")
            .select("doc", "copy", "source", "block", "words", "pass", "shard", F.xxhash64("hash", "pass", "shard").alias("spot")))


def shard_rows(df: DataFrame, drawn: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """shard, spot and row: a row of `df` for each shard and pass that draws from it, with the words of these blocks as its text.

    A text of which all blocks are drawn stays as it is; of others the drawn blocks stand in their order with the
    white space that follows each word. Rows without a drawn block go. Rows that agree in key, source and text are
    drawn by themselves, each as the first of them in the order of its columns. `spot` is that of the first block drawn.
    """
    takes = drawn.groupBy(F.col("doc").alias("d"), "copy", "pass", "shard").agg(
        F.sort_array(F.collect_list("block")).alias("taken"), F.min("spot").alias("spot"))
    rows = one_row_per_key(df.select(_doc(*map(quoted, (key, source, text))).alias("key"), quoted(text).alias("text"), F.struct(*map(quoted, df.columns)).alias("row")))
    joined = rows.join(takes, rows["key"] == F.col("d"))
    parts = F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    taken = F.transform("taken", lambda i: F.array_join(F.slice(parts, i * BLOCK_WORDS + 1, F.lit(BLOCK_WORDS)), ""))
    whole = F.ceil(F.regexp_count("text", F.lit(WORD)) / BLOCK_WORDS) == F.size("taken")
    new = F.when(whole, F.col("text")).otherwise(F.array_join(taken, ""))
    return joined.select("shard", "spot", F.struct(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns]).alias("row"))


def shuffled_locally(rows: DataFrame, draws: int, shards: int = SHARDS) -> DataFrame:
    """`rows` by shard and by slice of its random order, in that order inside each partition.

    With `draws` rows in all a slice has about SLICE_ROWS, so that no task sorts a whole shard of a large mixture.
    """
    slices = draws // (shards * SLICE_ROWS) + 1
    part = F.floor((F.col("spot") / float(1 << 63) + 1) / 2 * slices).alias("slice")
    return rows.withColumn("slice", part).repartition(shards * slices, "shard", "slice").sortWithinPartitions("shard", "slice", "spot").drop("slice")


def drawn_texts(df: DataFrame, drawn: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """The columns of `df` of `shard_rows`, shuffled locally: shard after shard in a partition, each in its random order."""
    rows = shuffled_locally(shard_rows(df, drawn, key, source, text), drawn.count(), shards)
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns])


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Key, size, source_size, target and shard_words (words that each shard draws, passes counted) of every row.

    A null text has size 0; null is a source like any other; rows are documents of their own also where keys repeat
    or are null; documents without words have zeros. An empty table gives an empty result. The table of sources and a
    row of quotas with a number for each source are held by one task: a source is a collection, not a host or author.
    """
    if key in ("size", "source_size", "target", "shard_words"):
        raise ValueError(f"a key can't be named {key}, like a result")
    sized = sized_documents(df, key, source, text)
    targets = stored(source_targets(sized), "targets")
    blocks = mixture(sized, targets, shards).groupBy(F.col("doc").alias("d"), F.col("copy").alias("c")).agg(
        F.collect_list(F.struct("shard", "words")).alias("blocks"))
    words = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.aggregate(
        F.coalesce("blocks", F.array().cast("array<struct<shard: int, words: long>>")), F.lit(0).cast("long"),
        lambda at, x: at + F.when(x["shard"] == i, x["words"]).otherwise(0)))
    rows = sized.join(small_or_not(targets.withColumnRenamed("source", "s")), sized["source"].eqNullSafe(F.col("s")))
    return (rows.join(blocks, (rows["doc"] == F.col("d")) & (rows["copy"] == F.col("c")), "left")
            .select(F.col("key").alias(key), "size", "source_size", "target", words.alias("shard_words")))
