"""Prefix trie of conversations by fixed-length block hashing.

Conversations are cut into blocks of ``BLOCK`` turns. A prefix that ends at a block's
end has a digest: the exclusive-or of the digests of its blocks, each of which covers the
block's place and all its turns. Grouping by these digests gives the trie of blocks. Only
where a block has siblings that differ are its turns looked at: the turn prefixes of the
distinct blocks there (not of the conversations) are grouped; elsewhere a block is a chain.

Sums over subtrees need no recursion. A node belongs to its smallest conversation, so a
conversation shares a prefix of Z bytes with smaller ones and owns the rest of its path;
a subtree's saved bytes are the sum of Z over its members but the smallest, less what lies
above the node for each, and its leaves are the members that own the node they end at.

A node is known by two 60-bit lanes of SHA-256 digests with its depth inside.

Defined results: null roles and texts are empty; rows without conv_id are left out, and so
are columns of other names; turns are ordered null first, equal turns by role, then by the
text's first 64 characters, then by its digest (repeated rows are turns of their own);
conversations of any length are dealt over tasks; remainders are those of Spark's %; an
empty table gives no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scans import looked_up, running
from millrace.session import shuffle_partitions, stored

BLOCK = 4
HEADS = 9
NODE = ["a", "b"]


def lanes(digest: Column) -> tuple[Column, Column]:
    """Two longs of 60 bits from a hex digest."""
    cut = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return cut(1), cut(16)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 0), digest, bytes of every turn; the texts themselves stay behind."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), F.left(text, F.lit(64)).alias("_head"),
        F.substring(told, 1, 40).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_head"), F.col("digest")]
    return running(rows, "conv_id", order, [], [], "trie-turns").select("conv_id", "at", "digest", "bytes")


def head_of(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size) and turns (conv_id, at, digest, bytes), each conversation c after the
    first h turns of c - c % 5 in place of its own first h."""
    sizes = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "trie-sizes")
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.withColumn("h", head_of(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "base", "left")
    head = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "trie-conversations")
    heads = turns.filter(F.col("at") < HEADS - 1).withColumnRenamed("conv_id", "base").join(convs.filter("head > 0").select("base", "conv_id", "head"), "base")
    heads = heads.filter(F.col("at") < F.col("head")).select("conv_id", "at", "digest", "bytes")
    tails = turns.filter(F.col("at") >= head_of(F.col("conv_id"))).join(convs.select("conv_id", "h", "head"), "conv_id")
    tails = tails.select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "digest", "bytes")
    return convs.select("conv_id", "size"), heads.unionByName(tails)


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv_id, k (the block's number), turns (of it, in order), a, b (digest of the prefix that ends with it),
    pa, pb (of the prefix before it), above (bytes before it)."""
    cut = turns.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("k")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "bytes"))).alias("turns"))
    one, two = lanes(turn_digest(F.col("k"), F.col("turns"), F.size("turns")))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["bytes"])
    run = running(cut.select("*", one.alias("one"), two.alias("two"), size.alias("bytes")), "conv_id", [F.col("k")], ["one", "two"], ["bytes"], "trie-blocks")
    return run.select(
        "conv_id", "k", "turns", F.col("one_to").alias("a"), F.col("two_to").alias("b"), F.col("one_to").bitwiseXOR(F.col("one")).alias("pa"),
        F.col("two_to").bitwiseXOR(F.col("two")).alias("pb"), (F.col("bytes_to") - F.col("bytes")).alias("above"),
    )


def turn_digest(k: Column, turns: Column, n: Column) -> Column:
    """Hex digest of a block's first n turns and their depth."""
    depth = (k * BLOCK + n).cast("string")
    return F.sha2(F.concat(depth, F.lit(":"), F.array_join(F.transform(F.slice(turns, F.lit(1), n), lambda t: t["digest"]), "")).cast("binary"), 256)


def turn_nodes(groups: DataFrame, *values: str) -> DataFrame:
    """Nodes at every turn of block groups: depth, a, b, pa, pb, above (bytes above the node), and ``values``."""
    steps = groups.select("*", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("j"))
    before = F.aggregate(F.slice("turns", F.lit(1), F.col("j") - 1), F.col("above"), lambda s, t: s + t["bytes"])
    at = lambda n: lanes(turn_digest(F.col("k"), F.col("turns"), n))
    mine, up = at(F.col("j")), at(F.col("j") - 1)
    base = (F.col("pa"), F.col("pb"))
    first = F.col("j") == 1
    return steps.select(
        (F.col("k") * BLOCK + F.col("j")).alias("depth"), *[p.bitwiseXOR(x).alias(n) for n, p, x in zip(NODE, base, mine, strict=True)],
        *[F.when(first, p).otherwise(p.bitwiseXOR(x)).alias(n) for n, p, x in zip(("pa", "pb"), base, up, strict=True)], before.alias("above"), *values,
    )


def refined(groups: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Turn nodes of block groups (flag ``forked``: siblings differ); those of forked ones are grouped by digest."""
    names = list(sums)
    grouped = turn_nodes(groups.filter("forked"), *names).groupBy("depth", *NODE, "pa", "pb", "above").agg(*[how.alias(n) for n, how in sums.items()])
    return turn_nodes(groups.filter("not forked"), *names).unionByName(grouped)


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends (a, b, conv_id) -> a, b, ends_sha256 of each node's conv_ids in order, joined by commas. Ids become
    pieces of text in tasks dealt by ranges; only pieces meet at a node."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, held, size = TaskContext.get().partitionId() << 32, 0, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for a, b, c in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if now != (a, b) or size > 1 << 16:
                    if held:
                        out.append((*now, part + seq, ",".join(held)))
                    seq, now, held, size = seq + 1, (a, b), [], 0
                held.append(str(c))
                size += 8
            yield batch_of(out)
            out = []
        if held:
            yield batch_of([(*now, part + seq, ",".join(held))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        a, b, at, text = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string())], names=["a", "b", "piece", "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for a, b, _, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if now != (a, b):
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if now:
            out.append((*now, state.hexdigest()))
        a, b, digest = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], names=["a", "b", "ends_sha256"])

    n = shuffle_partitions(ends.sparkSession)
    pieces = ends.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined, "a long, b long, piece long, text string")
    whole = stored(pieces, "trie-ends").repartition(n, *NODE).sortWithinPartitions(*NODE, "piece")
    return whole.mapInArrow(hashed, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    zero = F.lit(0).cast("long")
    convs, turns = rebuilt(turns_of(conversations))
    blocks = stored(blocks_of(turns), "trie-prefixes")
    key = ["k", *NODE]
    groups = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("pa", "pb", "above", "turns")])
    groups = stored(groups, "trie-groups")
    siblings = stored(groups.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("_n")), "trie-siblings")
    n_groups = groups.count()
    groups = stored(looked_up(groups, siblings, ["pa", "pb"], "_n", n_groups).withColumn("forked", F.col("_n") > 1).drop("_n"), "trie-forks")

    nodes = refined(groups.select("k", "turns", *NODE, "pa", "pb", "above", "forked", "n_convs", "conv_id"), {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")})
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = top.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("above"), "n_convs", "conv_id")
    nodes = stored(nodes.unionByName(root), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")

    # What a conversation shares with smaller ones, and whether it owns a leaf.
    owned = nodes.groupBy("conv_id").agg(F.min("above").alias("_shared"), F.max(F.col("n_children") == 0).alias("_leaf"))
    ends = blocks.groupBy("conv_id").agg(F.max_by(F.struct(*NODE, (F.col("above") + F.aggregate("turns", zero, lambda s, t: s + t["bytes"])).alias("bytes")), "k").alias("e")).select("conv_id", "e.*")
    facts = convs.select("conv_id").join(ends, "conv_id", "left").join(owned, "conv_id", "left")
    facts = stored(facts.select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NODE], F.coalesce("_shared", "bytes", zero).alias("z"), F.coalesce("_leaf", F.lit(False)).cast("long").alias("leaf")), "trie-facts")

    # Their sums over the members of each node with more than one.
    many = F.col("n_convs") > 1
    per = blocks.select("conv_id", *key).join(facts.select("conv_id", "z", "leaf"), "conv_id").groupBy(*key).agg(F.sum("z").alias("z"), F.sum("leaf").alias("leaves"))
    summed = refined(groups.join(per, key).select("k", "turns", *NODE, "pa", "pb", "above", "forked", "z", "leaves"), {"z": F.sum("z"), "leaves": F.sum("leaves")}).select(*NODE, "z", "leaves")
    all_of = facts.agg(F.sum("z").alias("z"), F.sum("leaf").alias("leaves")).select(zero.alias("a"), zero.alias("b"), "z", "leaves")
    own = facts.select("conv_id", F.col("z").alias("own_z"))
    shared = nodes.filter(many).join(summed.unionByName(all_of), NODE).join(own, "conv_id")
    shared = shared.withColumn("saved_tokens", F.col("z") - F.col("own_z") - (F.col("n_convs") - 1) * F.col("above"))
    columns = ["conv_id", "depth", *NODE, "pa", "pb", "n_convs", "n_children"]
    full = shared.select(*columns, F.col("leaves").alias("n_leaves"), "saved_tokens").unionByName(nodes.filter(~many).select(*columns, F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens")))

    # A node's parent is of the same conversation, or the node is the top of what its conversation owns.
    full = stored(full.join(ends_digests(facts), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie-full")
    parents = full.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_w")).filter("_w > 0")
    with_parent = looked_up(full.filter("depth > 0"), parents, ["pa", "pb"], "_w", full.count())
    result = with_parent.drop("_w").unionByName(full.filter("depth = 0").withColumn("parent_conv_id", none))
    return result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
