"""The prefix trie of conversations, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Sequences are told apart by sums of 128 bits of hashes of (place, role,
text), which are running sums and so need no task that holds a whole conversation. The trie becomes a linked list of
arcs: one enters a node, one leaves it. The list is ranked (``scans.list_positions``); then the sum over a subtree is
the running sum of values at the leaving arc, less that at the entering one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut_lineage
from tarmac.llm.scans import list_positions, running_sums

_LOW = 0xFFFFFFFF
#: Children of a node that look for it in one copy of its row.
PER_COPY = 1024


def turn_digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, points``: two hashes of role and text (null: empty) and the code points of the text.

    Rows without conv_id belong to no conversation and are left out, and so are other columns.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = conversations.where("conv_id is not null")
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"), F.length(text).cast("long").alias("points"))


def in_order(turns: DataFrame) -> DataFrame:
    """``turns`` with ``depth``: 1 for a conversation's first turn (null first); equal turns are ordered by their hashes."""
    one = turns.withColumn("one", F.lit(1).cast("long"))
    return running_sums(one, ["conv_id"], ["turn", "a", "b"], ["one"]).withColumnRenamed("run_one", "depth").drop("one", "turn")


def grafted(turns: DataFrame, block: int = 100, spread: int = 6) -> DataFrame:
    """``conv_id, depth, a, b, points``: each conversation c begins with the first h turns of conversation c - c % block
    (all if fewer, none if there is none) and goes on with its own after its first h; h is crc32(c in decimal) % ``spread``.

    Up to spread - 1 turns of a conversation are written to the block's at most ``block`` others.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": F.expr(f"conv_id - conv_id % {block}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread})
    lengths = ids.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("held"))
    plan = cut_lineage(ids.join(lengths, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken")))
    heads = turns.where((F.col("depth") < spread) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "base")
    first = plan.where("taken > 0").join(heads, "base").where("depth <= taken").select("conv_id", "depth", "a", "b", "points")
    later = turns.where("depth > 0").join(plan.select("conv_id", "h", "taken"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "points")
    return first.unionByName(later)


def _lanes() -> dict[str, F.Column]:
    """128 bits of hash of a turn at its place, in four columns whose sums over 2**31 turns stay within a long."""
    x, y = F.xxhash64("a", "b", "depth"), F.xxhash64(F.lit(1), "b", "depth", "a")
    return {"l0": F.shiftrightunsigned(x, 32), "l1": x.bitwiseAND(F.lit(_LOW)), "l2": F.shiftrightunsigned(y, 32), "l3": y.bitwiseAND(F.lit(_LOW))}


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and where each conversation ends.

    ``turns``: conv_id, depth (1, 2, ... without gaps), a, b, points, one row each; ``conversations``: conv_id, each once,
    also those without turns. All that starts with a sequence are members of its node; the root (depth 0) has all.

    Nodes: ``conv_id`` (the smallest member), ``depth``, which together name a node, ``parent_conv_id`` (the parent's;
    null at the root), ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in the subtree, itself included),
    ``saved_tokens`` (over the subtree, (members - 1) times the points of the node's last turn), ``k1, k2`` (its hashes).
    Ends: ``conv_id, depth, k1, k2``, a row for each conversation. Without conversations there is no node.
    """
    lanes = [f"l{i}" for i in range(4)]
    summed = running_sums(turns.withColumns(_lanes()), ["conv_id"], ["depth"], lanes)
    key = lambda own: (F.xxhash64(*own), F.xxhash64(F.lit(1), *reversed(own)))
    k1, k2 = key([F.col(f"run_{x}") for x in lanes])
    p1, p2 = key([F.col(f"run_{x}") - F.col(x) for x in lanes])
    zero = [F.lit(0).cast("long") for _ in lanes]
    r1, r2 = key(zero)
    none = F.lit(None).cast("long")
    root = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), r1.alias("k1"), r2.alias("k2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("points"))
    prefixes = cut_lineage(summed.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "points").unionByName(root))
    grouped = prefixes.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(x).alias(x) for x in ("p1", "p2", "points")))
    # Numbered along the conversations, so that the tour mostly goes on at nearby numbers.
    nodes = cut_lineage(grouped.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("node", F.monotonically_increasing_id()))
    tour = _tour(nodes)
    values = tour.select("arc", "node", F.when(F.col("leaf") & (F.col("arc") % 2 == 0), 1).otherwise(0).cast("long").alias("leaves"), F.when(F.col("arc") % 2 == 0, F.col("own")).otherwise(0).cast("long").alias("saved"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "k1", "k2")
    placed = values.join(list_positions(tour.select("arc", "next")), "arc")
    sums = running_sums(placed, [], ["position"], ["leaves", "saved"])
    over = lambda v: (F.max(f"run_{v}") - F.min(f"run_{v}") + F.max(v))
    kept = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "k1", "k2")
    whole = sums.groupBy("node").agg(*(F.first(c).alias(c) for c in kept), over("leaves").alias("n_leaves"), over("saved").alias("saved_tokens"))
    longest = F.max(F.struct("depth", "k1", "k2")).alias("x")
    return whole.drop("node"), prefixes.groupBy("conv_id").agg(longest).select("conv_id", "x.*")


def _tour(nodes: DataFrame) -> DataFrame:
    """``arc, next`` (2 * node enters it, 2 * node + 1 leaves it; the last has next -1) with the columns of the node.

    Children are numbered inside their parent by running sums. A parent of many is written once for each PER_COPY of
    them, so that no task meets all children of one node.
    """
    under = nodes.where("depth > 0").withColumn("one", F.lit(1).cast("long"))
    ranked = cut_lineage(running_sums(under, ["depth", "p1", "p2"], ["conv_id"], ["one"]).withColumnRenamed("run_one", "rank").drop("one"))
    counts = ranked.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = cut_lineage(nodes.join(counts, ["depth", "k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    copies = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.expr(f"sequence(0L, n_children div {PER_COPY})")).alias("copy"))
    placed = cut_lineage(ranked.withColumn("copy", F.expr(f"rank div {PER_COPY}")).join(copies, ["depth", "p1", "p2", "copy"]).select("node", "parent", "parent_conv_id", "rank"))
    firsts = placed.where("rank = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    after = placed.select("parent", (F.col("rank") - 1).alias("rank"), F.col("node").alias("sibling"))
    follow = placed.join(after, ["parent", "rank"], "left").select("node", "parent", "parent_conv_id", "sibling")
    known = full.join(follow, "node", "left").join(firsts, "node", "left")
    enter = F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1)
    leave = F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1).cast("long"))
    arcs = F.explode(F.array(F.struct((F.col("node") * 2).alias("arc"), enter.alias("next")), F.struct((F.col("node") * 2 + 1).alias("arc"), leave.alias("next")))).alias("x")
    own = ((F.col("n_convs") - 1) * F.col("points")).alias("own")
    return cut_lineage(known.select(arcs, "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "k1", "k2", own, (F.col("n_children") == 0).alias("leaf")).select("x.*", "*").drop("x"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with the same node, of their ids with commas between."""
    node, state = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(x).to_pylist() for x in ("depth", "k1", "k2"))))
        done = []
        for key, ids in zip(keys, batch.column("ids").to_pylist()):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield _digests(done)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, k1, k2, digest = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (depth, k1, k2)] + [pa.array(digest, pa.string())], ["depth", "k1", "k2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256``: the SHA-256 of the ascending decimal ids, comma-joined, that end at each node.

    Ids are joined in blocks of 1024 numbers first. A digest is one pass over its text, so the blocks of a node are
    streamed through one task, sorted outside of memory; nothing of a node is held but the state of its digest.
    """
    blocks = ends.groupBy("depth", "k1", "k2", F.shiftright("conv_id", 10).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    sent = blocks.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "block")
    return sent.mapInArrow(_chained, "depth long, k1 long, k2 long, ends_sha256 string")


def described(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256``; a node where no conversation ends has that of the empty string."""
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends_digests(ends), ["depth", "k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).drop("k1", "k2")


def grafted_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of the conversations as ``grafted`` joins them, with ``ends_sha256``.

    Rows are ordered by turn, null first; rows of a conversation with one turn number are ordered by the hashes of their
    contents and all count, repeated or not. Null role or text is empty. Rows without conv_id and other columns are left
    out; an empty table gives no rows.
    """
    turns = cut_lineage(in_order(turn_digests(conversations)))
    nodes, ends = prefix_trie(grafted(turns), turns.where("depth = 1").select("conv_id"))
    return described(nodes, ends)
