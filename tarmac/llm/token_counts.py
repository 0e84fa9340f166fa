"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.llm.common import cut_lineage
from tarmac.llm.tokens import default_vocabulary, token_lengths

#: Lengths in a block of the two-level suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length (a null or empty text: 0 tokens).

    Only lengths leave the encoding map, and counts are made before the shuffle, so a hot length costs a row a task. The
    histogram is kept in the shared folder: texts are encoded once, whatever is asked of it.
    """
    lengths = token_lengths(docs, vocabulary or default_vocabulary())
    return cut_lineage(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))


def _suffix(value: Column, block: str = "block", key: str = "n_tokens") -> Column:
    """Sum of value over greater keys of the same block."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(block).orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, as context limit: what a corpus cut at L tokens a document holds.

    ``n_tokens`` (L), ``n_docs`` with exactly L, ``n_docs_longer``, ``n_tokens_longer`` (their whole tokens),
    ``total_tokens`` of all documents, ``tokens_within`` (the total if each document is truncated at L),
    ``rank_from`` and ``rank_to`` (0-based ranks that L holds in ascending order, so the quantile q is the row with
    rank_from <= floor(q * (n - 1)) <= rank_to). Between two lengths that occur, a limit c has
    ``tokens_within = total_tokens - n_tokens_longer + c * n_docs_longer`` with the sums of the row below it.

    Suffix sums in two levels: inside blocks of lengths, and over the blocks' totals, whose number is the largest
    length over BLOCK whatever the number of documents. An empty table gives no rows.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_above") for x in "dt"), *(F.sum(x).over(every).alias(f"{x}_all") for x in "dt"))
    found = h.join(blocks, "block").select("*", (_suffix(F.col("n_docs")) + F.col("d_above")).alias("n_docs_longer"), (_suffix(F.col("tokens")) + F.col("t_above")).alias("n_tokens_longer"))
    return found.select(
        "n_tokens", "n_docs", "n_docs_longer", "n_tokens_longer", F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("n_tokens_longer") + F.col("n_tokens") * F.col("n_docs_longer")).alias("tokens_within"),
        (F.col("d_all") - F.col("n_docs_longer") - F.col("n_docs")).alias("rank_from"), (F.col("d_all") - F.col("n_docs_longer") - 1).alias("rank_to"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """``n_tokens``: the length of rank floor(q * (n - 1)); no row for an empty table."""
    rank = F.floor(F.lit(q) * (F.col("n_docs_longer") + F.col("rank_to")))
    return limits.where(rank.between(F.col("rank_from"), F.col("rank_to"))).select("n_tokens")
