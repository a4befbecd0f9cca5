"""Prefix trie of conversations by collapsing whole sequences.

A conversation is a sequence of turns; a turn is known by a 128-bit digest of
role and text, so texts are read once and never shuffled. The key of a prefix is
the running XOR of hashes of (depth, digest), two words of 64 bits.

1. Identical conversations are grouped into one weighted sequence, which the
   smallest conv_id stands for; only its prefixes go on, so copies cost one row.
2. A sequence that is a proper prefix of another one is no leaf: an anti-join of
   ends with inner prefixes leaves the leaves.
3. Weighted prefixes are summed by key, partial sums first. Sums over subtrees
   need no walk: a node's subtree is the tails of the sequences through it. A
   node that several sequences share is counted by its owner, the sequence with
   the smallest conv_id; an owner of a node owns all that follows on its path.

The list of a node's ends is never held: ids are sorted over all tasks, written
out as text piece by piece, and the pieces of a node stream through one SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twofold.sources.tables import stage

SHARE, SPREAD = 5, 9
KEY = ["depth", "x1", "x2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, bytes): turns from 1 in order of turn, null first, equal turns by digest.

    Null role and text are empty. Rows without conv_id are no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.withColumn("place", F.row_number().over(order)).drop("turn")


def rebuilt(numbered: DataFrame, share: int = SHARE, spread: int = SPREAD) -> DataFrame:
    """(conv_id, part, place, digest, bytes): turns of rebuilt conversations in order of (part, place), a textless start first.

    Conversation c gets the first h turns of conversation c - c % share and keeps
    its own turns after its first h; h is crc32 of c as text, modulo ``spread``.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % spread
    first = numbered.where("place = 1")
    none = F.lit(0).cast("int")
    start = first.select(c, F.lit(0).alias("part"), none.alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    heads = numbered.where(F.col("place") < spread).withColumnRenamed("conv_id", "donor")
    lent = first.select(c, (c - c % share).alias("donor"), h.alias("h")).join(heads, "donor").where("place <= h")
    own = numbered.where(F.col("place") > h)
    return start.union(lent.select(c, F.lit(1), "place", "digest", "bytes")).union(own.select(c, F.lit(2), "place", "digest", "bytes"))


def _running(value: Column) -> Column:
    return value.over(Window.partitionBy("conv_id").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, 0))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per conversation and depth: key, key of the parent, bytes of the last text and of all up to it, and whether it is the end."""
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    rows = turns.withColumns({"depth": (F.row_number().over(order) - 1).cast("long"), "last": F.lead("part").over(order).isNull()})
    own = {f"h{i}": F.when(F.col("depth") > 0, F.xxhash64(F.lit(i), "depth", "digest")).otherwise(F.lit(0).cast("long")) for i in (1, 2)}
    keyed = rows.withColumns(own).withColumns(
        {"x1": _running(F.bit_xor("h1")), "x2": _running(F.bit_xor("h2")), "upto": _running(F.sum("bytes"))}
    )
    return keyed.select(
        "conv_id", *KEY, F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"), "bytes", "upto", "last"
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): SHA-256 of the ascending ids, joined by commas, of each node with ends (depth, x1, x2, conv_id)."""

    def runs(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        k = pdf[KEY].to_numpy(np.int64)
        cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1), True])
        return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    def write(batches):
        for pdf in batches:
            if len(pdf):
                ids, keys = pdf["conv_id"].to_numpy(np.int64), pdf[KEY].to_numpy(np.int64)
                out = [(*keys[a].tolist(), int(ids[a]), ",".join(map(str, ids[a:b].tolist()))) for a, b in runs(pdf)]
                yield pd.DataFrame(out, columns=[*KEY, "first", "ids"])

    def digest(batches):
        now, sha = None, None
        for pdf in batches:
            out = []
            for key, text in zip(pdf[KEY].itertuples(index=False, name=None), pdf["ids"]):
                if key == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(text.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*KEY, "ends_sha256"])

    key = "depth long, x1 long, x2 long"
    by_id = ends.repartitionByRange("x1", "x2", "depth", "conv_id").sortWithinPartitions("x1", "x2", "depth", "conv_id")
    pieces = by_id.mapInPandas(write, f"{key}, first long, ids string")
    return pieces.repartition("x1", "x2", "depth").sortWithinPartitions("x1", "x2", "depth", "first").mapInPandas(digest, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, share: int = SHARE, spread: int = SPREAD) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie.

    A node is a distinct sequence of first turns of rebuilt conversations (see
    ``rebuilt``), from the textless root; its members start with it, conv_id is
    the smallest, and its subtree includes itself. saved_tokens sums (n_convs - 1)
    times the UTF-8 bytes of the last text over the subtree; ends_sha256 is taken
    over the ids of members that end there. Null role and text are empty, a null
    turn comes first, equal turns of a conversation go by the digest of role and
    text and repeated rows are turns each. Rows without conv_id are left out, other
    columns are not read, texts of any length are only hashed. An empty table gives
    an empty table. The turns of one conversation are numbered by one task, whose
    sort spills; copies of a conversation are spread.
    """
    turns = stage(numbered_turns(conversations), "turns")
    paths = stage(prefixes(rebuilt(turns, share, spread)), "paths")
    sequences = paths.where("last").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("upto").alias("total")
    )
    weighted = stage(paths.join(sequences.select("conv_id", "weight", "total"), "conv_id"), "weighted")
    inner = weighted.where("not last").select(*KEY).distinct()
    leaves = weighted.where("last").select("conv_id", *KEY).join(inner, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    nodes = stage(
        weighted.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("bytes").alias("bytes")),
        "nodes",
    )
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("top"), F.sum("bytes").alias("owned"))
    tail = F.col("total") - F.col("upto") + F.col("bytes")
    counted_once = F.when(F.col("depth") >= F.col("top"), tail).otherwise(F.coalesce("owned", F.lit(0)))
    through = (
        weighted.join(leaves.join(owners, "conv_id", "full"), "conv_id", "left")
        .select(*KEY, "conv_id", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("weight") * tail - counted_once).alias("saved"))
        .groupBy(*KEY)
        .agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    parents = nodes.select(F.col("depth").alias("pd"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    above = nodes.where("depth > 0").withColumn("pd", F.col("depth") - 1).join(parents, ["pd", "p1", "p2"])
    none = F.lit(None)
    facts = (
        through.select(*KEY, "conv_id", "n_convs", "n_leaves", "saved_tokens", none.cast("long").alias("parent_conv_id"), none.cast("long").alias("n_children"), none.cast("string").alias("ends_sha256"))
        .unionByName(above.select(*KEY, "parent_conv_id"), allowMissingColumns=True)
        .unionByName(
            nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children")),
            allowMissingColumns=True,
        )
        .unionByName(end_digests(paths.where("last").select(*KEY, "conv_id")), allowMissingColumns=True)
    )
    return facts.groupBy(*KEY).agg(
        F.max("conv_id").alias("conv_id"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.coalesce(F.max("n_children"), F.lit(0)).cast("long").alias("n_children"),
        F.max("n_leaves").alias("n_leaves"),
        F.max("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
