"""Prefix trie of conversations by whole-sequence collapse: identical conversations become one weighted sequence,
sequences that are proper prefixes of others are told apart from leaves by an anti-join, and the prefixes of the
sequences are summed with their weights. No node's members, children or descendants are ever gathered in one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm.frames import quoted, stored

# Conversations of a block share a head; the number of turns shared is a hash modulo HEADS.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of a node's key: a chain of SHA-256 over the turns, cut to 128 bits.
KEY_BYTES = 16
ROOT = b"\0" * KEY_BYTES
# Members of a node are joined to texts of about this many ids, on any task, before one task hashes them in order.
IDS_A_TEXT = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def conversation_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, each as the digest of role and text and its words.

    Order is by turn, nulls first, then by digest. A null role or text is empty; rows without a conversation's number
    belong to none and are left out; repeated rows are turns of their own; other columns are not looked at.
    """
    role, text = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY_BYTES))
    one = F.struct(quoted(turn).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = df.filter(quoted(conv).isNotNull()).select(quoted(conv).cast("long").alias("conv_id"), one.alias("one"))
    # one shuffle serves the conversation and the block it shares a head with
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).repartition("base")
    turns = F.array_sort(F.collect_list("one"))
    return rows.groupBy("base", "conv_id").agg(F.transform(turns, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the block's first conversation, then the own turns after the first h."""
    heads = F.max(F.when(F.col("conv_id") == F.col("base"), F.struct(F.slice("turns", 1, HEADS - 1).alias("turns")))).over(Window.partitionBy("base"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.array().cast("array<struct<digest:binary,words:bigint>>")
    with_head = turns.select("conv_id", "turns", F.coalesce(heads["turns"], none).alias("head"), shared.alias("h"))
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return with_head.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), own).alias("turns"))


def _paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, path, below): keys of all prefixes of a conversation, the root's first and its own last, and the words
    from the last turn of each prefix on."""
    def run(batches):
        for batch in batches:
            turns = batch.column("turns")
            digests, words = turns.flatten().field("digest").to_pylist(), turns.flatten().field("words").to_pylist()
            bounds, at = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy())]), 0
            paths, sums = [], []
            for start, end in zip(bounds[:-1], bounds[1:]):
                path = [ROOT]
                for digest in digests[start:end]:
                    path.append(hashlib.sha256(path[-1] + digest).digest()[:KEY_BYTES])
                paths.append(path)
                sums.append(np.cumsum([0, *words[start:end]][::-1])[::-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([p[-1] for p in paths], pa.binary()), pa.array(paths, pa.list_(pa.binary())),
                                              pa.array(sums, pa.list_(pa.int64()))], ["conv_id", "key", "path", "below"])

    return conversations.select("conv_id", "turns").mapInArrow(run, "conv_id long, key binary, path array<binary>, below array<long>")


def _end_hashes(members: DataFrame) -> DataFrame:
    """(key, sha): hash of the ids that end at a node, in order. Ids of a large group are sorted and joined to texts by many
    tasks; SHA-256 then reads these texts one after the other, without holding them."""
    def join(batches):
        key, first, ids = None, None, []
        for batch in batches:
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or len(ids) >= IDS_A_TEXT:
                    if ids:
                        yield record([key, first, ",".join(map(str, ids))])
                    key, first, ids = k, conv, []
                ids.append(conv)
        if ids:
            yield record([key, first, ",".join(map(str, ids))])

    def record(row):
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.string())], ["key", "first", "ids"])

    def chain(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "sha"])

    texts = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key binary, first long, ids string")
    return texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(chain, "key binary, sha string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct beginning of a rebuilt conversation, from the root without turns.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (childless nodes at or below it), saved_tokens (words that need not be stored again at or below it), ends_sha256 (of the
    ids of the members that end there). Members of a node are the conversations that begin with it. For nulls,
    repeated rows and other columns see `conversation_turns`; an empty table gives no rows. A conversation's digests
    (24 bytes a turn) are held in one row; its texts never are.
    """
    paths = stored(_paths(rebuilt(conversation_turns(df, conv, turn, role, text))), "paths")
    # identical conversations: one sequence, its smallest id and its weight
    sequences = stored(paths.groupBy("key").agg(F.min(F.struct("conv_id", "path", "below")).alias("one"), F.count("*").alias("weight"))
                       .select("key", "one.*", "weight"), "sequences")

    at = sequences.select("conv_id", "weight", "path", F.posexplode("path").alias("depth", "node"))
    parent = F.when(F.col("depth") > 0, F.get("path", F.col("depth") - 1))
    nodes = stored(at.select("node", "conv_id", "weight", "depth", parent.alias("parent"))
                   .groupBy("node").agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").cast("long").alias("depth"),
                                        F.first("parent").alias("parent")), "nodes")

    inner = nodes.filter("parent is not null").select(F.col("parent").alias("key")).distinct()
    leaves = sequences.join(inner, "key", "left_anti").withColumn("leaf", F.lit(1))
    prefixes = sequences.join(inner, "key", "left_semi").withColumn("leaf", F.lit(0))
    # A node is kept once where its smallest member passes; that conversation's path has all its ancestors. From some depth on,
    # all nodes of a path belong to it, because members only get fewer on the way down.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").cast("int").alias("own_from"))
    marked = leaves.unionByName(prefixes).join(owned, "conv_id", "left")
    at = marked.select("weight", "leaf", "own_from", "below", F.posexplode("path").alias("depth", "node"))
    twice = F.get("below", F.greatest("depth", "own_from"))
    saved = F.col("weight") * F.get("below", F.col("depth")) - F.when(F.col("own_from").isNull(), 0).otherwise(twice)
    totals = at.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    none = F.lit(None)
    facts = (nodes.select(F.col("node").alias("key"), "n_convs", "conv_id", "depth", "parent", none.cast("long").alias("n_leaves"), none.cast("long").alias("saved_tokens"),
                          F.lit(0).alias("child"), none.cast("string").alias("sha")))
    empty = lambda **given: [given.get(c, none.cast(t)).alias(c) for c, t in facts.dtypes]
    facts = (facts.unionByName(totals.select(*empty(key=F.col("node"), n_leaves=F.col("n_leaves"), saved_tokens=F.col("saved_tokens"))))
             .unionByName(nodes.filter("parent is not null").select(*empty(key=F.col("parent"), child=F.lit(1))))
             .unionByName(_end_hashes(paths.select("key", "conv_id")).select(*empty(key=F.col("key"), sha=F.col("sha")))))
    whole = facts.groupBy("key").agg(*[F.max(c).alias(c) for c in ("n_convs", "conv_id", "depth", "parent", "n_leaves", "saved_tokens", "sha")], F.sum("child").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
