"""Graph jobs over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made on a local master (tests on one machine); a cluster, whose machines do
    not see each other's folders, is refused.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read again.

    A checkpoint keeps the size that the optimiser guessed, a product at each join, whose digits double with each round
    of a loop until planning stands still; files have their true size.
    """
    path = f"{shared_folder(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the least node reachable) of every node that has an edge.

    Each round every node points to its least neighbour. Such pointers have no cycles but of two nodes that choose each
    other, of which the lesser becomes the root. Pointers are doubled until all lead to roots, edges are carried over to
    the roots, and the next round works on these. No node with an edge stays alone, so a round at least halves the nodes:
    rounds, and doublings in each, grow with the logarithm of the nodes whatever the shape. The loop ends when no edge is
    left. All is stored each time; minima are made before the shuffle, so a node with many edges costs a row a task.
    """
    one_way = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    links = stored(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while labels is None or not links.isEmpty():
        roots = _roots(links)
        if labels is None:
            labels = roots
        else:
            labels = stored(labels.join(roots.select(F.col("node").alias("at"), F.col("root").alias("further")), F.col("root") == F.col("at"), "left").select("node", F.coalesce("further", "root").alias("root")))
        at_a, at_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        links = stored(links.join(at_a, "a").join(at_b, "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


def _roots(links: DataFrame) -> DataFrame:
    """``node, root`` where each node of ``links`` (a, b: both ways) points to its least neighbour, followed to the end."""
    chosen = links.groupBy("a").agg(F.min("b").alias("up"))
    back = chosen.select(F.col("a").alias("at"), F.col("up").alias("further"))
    mutual = (F.col("further") == F.col("a")) & (F.col("a") < F.col("up"))
    roots = stored(chosen.join(back, chosen.up == back["at"]).select(F.col("a").alias("node"), F.when(mutual, F.col("a")).otherwise(F.col("up")).alias("root")))
    while True:
        jump = roots.select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = stored(roots.join(jump, roots.root == jump["at"]).select("node", F.col("root").alias("old"), F.col("further").alias("root")))
        roots = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return roots


def two_colours(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component, side``: a side (0 or 1) for every node that has an edge, with the least node of each component on 0.

    As ``connected_components``, with a parity beside each pointer: an edge is an odd step, and where pointers are doubled
    or edges are carried over to roots, parities are added. So each node knows its number of steps along a spanning tree,
    in rounds that grow with the logarithm of the nodes, be there odd cycles or not. Where the component has none, the
    ends of every edge differ; where it has one, some edge has both ends on one side.
    """
    one_way = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.lit(1).alias("odd")).where("a is not null and b is not null and a <> b")
    links = stored(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "odd")).distinct())
    add = lambda x, y: F.col(x).bitwiseXOR(F.col(y))
    labels = None
    while labels is None or not links.isEmpty():
        roots = _odd_roots(links)
        if labels is None:
            labels = roots
        else:
            further = roots.select(F.col("node").alias("at"), F.col("root").alias("next"), F.col("odd").alias("more"))
            met = labels.join(further.hint("merge"), F.col("root") == F.col("at"), "left")
            labels = stored(met.select("node", F.coalesce("next", "root").alias("root"), F.col("odd").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("odd")))
        at_a, at_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
        carried = links.join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").where("root_a <> root_b")
        links = stored(carried.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"), add("odd", "odd_a").bitwiseXOR(F.col("odd_b")).alias("odd")).distinct())
    least = labels.groupBy("root").agg(F.min(F.struct("node", "odd")).alias("x"))
    return labels.join(least.hint("merge"), "root").select("node", F.col("x.node").alias("component"), add("odd", "x.odd").alias("side"))


def _odd_roots(links: DataFrame) -> DataFrame:
    """``node, root, odd`` as ``_roots``, with the parity of the way to the root; of two parities to one neighbour the even."""
    chosen = links.groupBy("a").agg(F.min(F.struct("b", "odd")).alias("x")).select("a", F.col("x.b").alias("up"), "x.odd")
    back = chosen.select(F.col("a").alias("at"), F.col("up").alias("further"))
    mutual = (F.col("further") == F.col("a")) & (F.col("a") < F.col("up"))
    roots = stored(chosen.join(back.hint("merge"), chosen.up == back["at"]).select(F.col("a").alias("node"), F.when(mutual, F.col("a")).otherwise(F.col("up")).alias("root"), F.when(mutual, 0).otherwise(F.col("odd")).alias("odd")))
    while True:
        jump = roots.select(F.col("node").alias("at"), F.col("root").alias("further"), F.col("odd").alias("more"))
        moved = stored(roots.join(jump.hint("merge"), roots.root == jump["at"]).select("node", F.col("root").alias("old"), F.col("further").alias("root"), F.col("odd").bitwiseXOR(F.col("more")).alias("odd")))
        roots = moved.select("node", "root", "odd")
        if moved.where("old <> root").isEmpty():
            return roots
