"""Token counts for every context limit from one exact histogram of encoded lengths.

Documents are encoded and counted by length (a partial aggregate on each task, then one row a length). Whatever a
context limit L asks for follows from sums over the lengths above L: how many documents are longer, how many tokens
remain after truncation to L (tokens of shorter documents plus L for each longer one), and any quantile. The suffix
sums are two-level: inside ranges of lengths, and over the few totals of the ranges, so no window holds all rows.

A null or empty text has length 0. An empty table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .session import cut

#: Lengths in one range of the two-level sums.
RANGE = 1024


def length_histogram(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """One row a length that occurs: n_tokens, n_docs. It is written out, so that no later use encodes again."""
    counted = bpe.lengths(docs.select(F.col(text)), path, pattern, text)
    return cut(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit.

    n_docs: documents of exactly L tokens; docs_over and tokens_over: documents longer than L and their tokens;
    truncated_total: tokens left if every document is cut to L; tokens_total: all tokens; docs_total: all documents;
    rank_share: share of documents of at most L tokens, so that the q-quantile is the least L whose share is >= q.
    """
    rows = histogram.withColumn("part", F.expr(f"n_tokens div {RANGE}"))
    sums = rows.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t"))
    higher = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        F.col("part").alias("of"),
        F.coalesce(F.sum("d").over(higher), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(higher), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("docs_total"),
        F.sum("t").over(whole).alias("tokens_total"),
    )
    longer = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    return (
        rows.join(sums, F.col("part") == F.col("of"))
        .withColumn("docs_over", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d_above"))
        .withColumn("tokens_over", F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")).over(longer), F.lit(0)) + F.col("t_above"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_over",
            "tokens_over",
            (F.col("tokens_total") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
            "docs_total",
            "tokens_total",
            (1 - F.col("docs_over") / F.col("docs_total")).alias("rank_share"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits, also ones no document has: limit, docs_over, truncated_total.

    Read from the suffix sums by one pass with a partial aggregate; the histogram isn't collected.
    """
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits]))
    each = sums.select(asked.alias("limit"), "n_tokens", "n_docs")
    longer = F.col("n_tokens") > F.col("limit")
    return each.groupBy("limit").agg(
        F.sum(F.when(longer, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least this share of the documents doesn't exceed: share, n_tokens."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    return sums.select(asked.alias("share"), "n_tokens", "rank_share").where("rank_share >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
