"""Running sums inside groups of any size, and the ranking of linked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import cut_lineage

#: Links of a list that are shortened at once, and of which a single task may hold the rest.
LINKS = 1 << 18
_END = -1


def running_sums(df: DataFrame, groups: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``run_<value>``: the sums inside each group (columns without nulls) up to each row in ``order``.

    Rows are range-partitioned by group and order, so that a group of any size spans as many tasks as it needs. Only the
    last group of a partition can go on in the next: its total, one row a partition, is carried over.
    """
    parted = cut_lineage(df.repartitionByRange(*groups, *order).withColumn("__block", F.spark_partition_id()))
    inside = Window.partitionBy("__block", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.withColumns({f"run_{v}": F.sum(v).over(inside) for v in values})
    sums = [F.sum(v).cast("long").alias(f"__{v}") for v in values]
    if groups:
        key = F.struct(*groups)
        ends = cut_lineage(parted.groupBy("__block").agg(F.min(key).alias("first"), F.max(key).alias("last")))  # a row a partition
        last = ends.select("__block", "last.*")
        tails = parted.join(F.broadcast(last), ["__block", *groups]).groupBy("__block", *groups).agg(*sums).withColumn("tail", F.lit(1))
        firsts = ends.select("__block", "first.*", *(F.lit(0).cast("long").alias(f"__{v}") for v in values), F.lit(0).alias("tail"))
    else:
        tails = parted.groupBy("__block").agg(*sums).withColumn("tail", F.lit(1))
        firsts = tails.select("__block", *(F.lit(0).cast("long").alias(f"__{v}") for v in values), F.lit(0).alias("tail"))
    earlier = (Window.partitionBy(*groups) if groups else Window).orderBy("__block", "tail").rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.unionByName(tails).withColumns({f"__{v}": F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)) for v in values})
    joined = summed.join(F.broadcast(carried.where("tail = 0").drop("tail")), ["__block", *groups], "left")
    totals = {f"run_{v}": F.col(f"run_{v}") + F.coalesce(f"__{v}", F.lit(0)) for v in values}
    return joined.withColumns(totals).drop("__block", *(f"__{v}" for v in values))


def _shorten(block: int):
    """Blocks of links (arc, next, size) with each stretch that lies in one block made one link of its first arc.

    An arc within a stretch comes out with ``head``, the first arc, and ``before``, the sizes ahead of it in the stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                held.append(whole.slice(start, block))
                count += held[-1].num_rows
                if count >= block:
                    yield _stretches(held)
                    held, count = [], 0
        if count:
            yield _stretches(held)

    return run


def _stretches(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    arc, follow, size = (np.concatenate([b.column(x).to_numpy(zero_copy_only=False) for b in batches]) for x in ("arc", "next", "size"))
    order = np.argsort(arc, kind="stable")
    arc, follow, size = arc[order], follow[order], size[order]
    own = np.arange(len(arc))
    at = np.minimum(np.searchsorted(arc, follow), len(arc) - 1)
    inner = arc[at] == follow  # the next arc is in the block
    first = own.copy()
    first[at[inner]] = own[inner]
    before = np.where(first == own, 0, size[first])
    while True:  # doubling: every arc points back to the first of its stretch
        further = first[first]
        if (further == first).all():
            break
        before = before + before[first]
        first = further
    last = np.flatnonzero(~inner)
    beyond, total = follow.copy(), size.copy()
    beyond[first[last]] = follow[last]
    total[first[last]] = before[last] + size[last]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (arc, beyond, total, arc[first], before)], ["arc", "next", "size", "head", "before"])


def list_positions(links: DataFrame, block: int = LINKS) -> DataFrame:
    """``arc, position`` (from 0) along the one list of ``links``: arc (not negative) and next, both long, -1 at the end.

    Stretches that lie in one block of links become one link of their first arc, with their length, until a block holds
    all; then positions are handed back to the arcs within, level by level (an arc has no more than a block's to serve).
    Blocks are first ranges of arcs, so that lists that mostly go on nearby get short at once. A level that leaves over
    half is followed by one where arcs toss coins and each with a zero is dealt to its next if that has a one: a quarter
    meet theirs, however the list runs. So levels grow with the logarithm of the links, and their sizes fall off.
    """
    level = cut_lineage(links.select("arc", "next", F.lit(1).cast("long").alias("size")))
    count, inner, by_coin = level.count(), [], False
    while True:
        if count <= block:
            dealt = level.coalesce(1)
        elif by_coin:
            coin = {x: F.pmod(F.xxhash64(x, F.lit(len(inner))), F.lit(2)) for x in ("arc", "next")}
            meet = F.when((coin["arc"] == 0) & (coin["next"] == 1), F.col("next")).otherwise(F.col("arc"))
            dealt = level.withColumn("meet", meet).repartition("meet").sortWithinPartitions("meet").drop("meet")
        else:
            dealt = level.repartitionByRange("arc").sortWithinPartitions("arc")
        done = cut_lineage(dealt.mapInArrow(_shorten(block), "arc long, next long, size long, head long, before long"))
        inner.append(done.where("arc <> head").select("arc", "head", "before"))
        level = done.where("arc = head").select("arc", "next", "size")
        if count <= block:
            break
        left = level.count()
        by_coin, count = left > count / 2, left
    known = level.select("arc", F.lit(0).cast("long").alias("position"))
    for members in reversed(inner):
        heads = known.select(F.col("arc").alias("head"), "position")
        found = members.join(heads, "head").select("arc", (F.col("position") + F.col("before")).alias("position"))
        known = cut_lineage(known.unionByName(found))
    return known
