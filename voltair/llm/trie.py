"""The prefix trie of conversations, from digests of their prefixes.

A node is a distinct sequence of the first d turns. Its digest is a hash chain over the
turns (SHA-256, cut to 128 bits), and its owner the smallest conversation that starts with
it. Whoever owns a prefix owns all longer ones of its own, so a conversation's nodes are a
chain from its first owned depth to its end. That depth is found by binary search: in each
round all open conversations look up the digest in the middle of what is left of them among
the prefix minima, by one join, and keep one half; a round sends half as much as the one
before. The chain hangs on the node above its first, found on the way.

Chains are summed bottom-up: inside a chain from its last node up, by a window; and a
chain's sums go to the nodes above it under the digests of its own prefix, added up before
they are shuffled. So the number of jobs depends on the longest conversation's logarithm
only, not on how deep chains nest.

Null role or text: empty; a null turn sorts first; ties of turn are ordered by role and
text, and repeated rows are turns of their own. Rows without a conv_id belong to no
conversation and are left out. Empty tables give empty results; other columns are ignored.
Digests and word counts of one conversation stand in one row (24 bytes a turn); texts are
read in batches, so their length is no matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Conversations that share a head: those of one run of so many ids; and the turns of a head, fewer than this.
GROUP, HEADS = 20, 4
#: Ids of a node's ends that are joined into one string before the strings meet, at most.
BLOCK = 1024
ROOT = hashlib.sha256(b"").digest()[:16]
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key binary, words): turns in order, each by a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("conv_id", pos.alias("pos"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, key, words): every conversation's head from the first of its group, then its own turns; a row of part 0 and without a key opens each."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    lead = convs.join(heads, "base").where("pos <= h").select("conv_id", F.lit(1).alias("part"), "pos", "key", "words")  # at most GROUP rows meet a row
    own = turns.withColumn("h", h).where("pos > h").select("conv_id", F.lit(2).alias("part"), "pos", "key", "words")
    opening = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    return opening.union(lead).union(own)


def chained(rows: DataFrame) -> DataFrame:
    """(conv_id, digests array<binary>, words array<long>): of each prefix, the empty one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("digests", pa.list_(pa.binary())), ("words", pa.list_(pa.int64()))])
        now, digests, words = None, [], []
        for b in batches:
            done = []
            for conv, key, count in zip(b["conv_id"].to_pylist(), b["key"].to_pylist(), b["words"].to_pylist(), strict=True):
                if key is None:
                    if now is not None:
                        done.append((now, digests, words))
                    now, digests, words = conv, [ROOT], [0]
                else:
                    digests.append(hashlib.sha256(digests[-1] + key).digest()[:16])
                    words.append(count)
            if done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now is not None:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(([now], [digests], [words]), schema, strict=True)], schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "key", "words").mapInArrow(run, "conv_id long, digests array<binary>, words array<long>")


def minima(chains: DataFrame) -> DataFrame:
    """(digest, conv_id, depth, words, n_convs): the nodes, each under its owner."""
    zipped = F.posexplode(F.arrays_zip("digests", "words")).alias("depth", "x")
    each = chains.select("conv_id", zipped).select("conv_id", "depth", "x.digests", "x.words")
    return each.groupBy(F.col("digests").alias("digest")).agg(F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.min("words").alias("words"), F.count("*").alias("n_convs"))


def first_owned(chains: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, first, above, above_digest) of the conversations, without the root's owner: the first owned depth (one more than the last depth: none), and the node above it."""
    ends = chains.agg(F.min("conv_id").alias("owner"), F.max(F.size("digests")).alias("most")).first()  # one row
    owner, most = ends["owner"], ends["most"] or 1
    rest = F.slice("digests", F.lit(2), F.size("digests"))
    state = chains.where(F.col("conv_id") != F.lit(owner)).select("conv_id", F.lit(0).cast("long").alias("low"), F.lit(owner).cast("long").alias("above"), F.lit(ROOT).alias("above_digest"), rest.alias("rest"))
    owners = nodes.select(F.col("digest").alias("probe"), F.col("conv_id").alias("owner"))
    closed = None
    for _ in range((most - 1).bit_length()):
        done = state.where("size(rest) = 0").drop("rest")
        closed = done if closed is None else closed.union(done)
        mid = F.floor((F.size("rest") + 1) / 2).cast("int")
        asked = state.where("size(rest) > 0").withColumn("mid", mid).withColumn("probe", F.element_at("rest", F.col("mid"))).join(owners, "probe")
        mine = F.col("owner") == F.col("conv_id")
        left = F.when(mine, F.slice("rest", F.lit(1), F.col("mid") - 1)).otherwise(F.slice("rest", F.col("mid") + 1, F.size("rest")))
        state = asked.select(
            "conv_id",
            F.when(mine, F.col("low")).otherwise(F.col("low") + F.col("mid")).alias("low"),
            F.when(mine, F.col("above")).otherwise(F.col("owner")).alias("above"),
            F.when(mine, F.col("above_digest")).otherwise(F.col("probe")).alias("above_digest"),
            left.alias("rest"),
        )
        state = materialise(state, "trie-search")
    last = state.drop("rest")
    found = last if closed is None else closed.union(last)
    return found.select("conv_id", (F.col("low") + 1).alias("first"), "above", "above_digest")


def ends_of(chains: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end. Ids are joined in blocks of id ranges, and the blocks' strings go through the hash one after another."""
    last = chains.select(F.element_at("digests", -1).alias("digest"), "conv_id", F.floor(F.col("conv_id") / BLOCK).alias("block"))
    joined = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")  # at most BLOCK ids
    blocks = last.groupBy("digest", "block").agg(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            out = []
            for digest, ids in zip(b["digest"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if digest != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = digest, hashlib.sha256(ids.encode())
                else:
                    h.update(f",{ids}".encode())
            if out:
                names, found = zip(*out, strict=True)
                yield pa.record_batch([pa.array(names, pa.binary()), pa.array(found, pa.string())], names=["digest", "ends_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["digest", "ends_sha256"])

    return blocks.repartition("digest").sortWithinPartitions("digest", "block").select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    chains = materialise(chained(rebuilt(turns_of(conversations))), "trie-chains")
    nodes = materialise(minima(chains), "trie-nodes")
    search = materialise(first_owned(chains, nodes), "trie-first")
    hung = search.join(chains.select("conv_id", F.size("digests").alias("size")), "conv_id").where("first < size")  # conversations that own nodes
    hung = materialise(hung.drop("size"), "trie-hung")
    attached = hung.groupBy(F.col("above_digest").alias("digest")).agg(F.count("*").alias("attached"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    whole = Window.partitionBy("conv_id")
    one = nodes.join(attached, "digest", "left").withColumn("attached", F.coalesce("attached", F.lit(0)))
    one = one.withColumn("last", F.col("depth") == F.max("depth").over(whole)).withColumn("top", F.min("depth").over(whole))
    leaf = F.max((F.col("last") & (F.col("attached") == 0)).cast("long")).over(whole)  # only a chain's last node can be one
    saved = F.sum((F.col("n_convs") - 1) * F.col("words")).over(up.rowsBetween(Window.unboundedPreceding, 0))
    own = one.select("digest", "conv_id", "depth", "n_convs", (F.col("attached") + (~F.col("last")).cast("long")).alias("n_children"), leaf.alias("leaf"), saved.alias("saved"), "top")
    own = materialise(own, "trie-own")
    sums = own.where("depth = top").select("conv_id", "leaf", "saved").join(hung.select("conv_id", "first"), "conv_id").where("leaf > 0 OR saved > 0")
    over = chains.select("conv_id", "digests").join(sums, "conv_id").select(F.explode(F.slice("digests", F.lit(1), F.col("first").cast("int"))).alias("digest"), "leaf", "saved")
    over = over.groupBy("digest").agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    above = hung.select("conv_id", F.col("first").alias("depth"), "above")
    found = own.join(above, ["conv_id", "depth"], "left").join(over, "digest", "left").join(ends_of(chains), "digest", "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return found.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
