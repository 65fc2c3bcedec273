"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their length in tokens, map-side first, so what is
shuffled has a row for each distinct length. Suffix sums over the histogram then
answer, for every context limit, how many documents are longer, how many tokens
fit, how many are cut, and what share of documents fits whole. The sums run in
bands of lengths with the bands' totals added, so no task holds all lengths.

Edge cases: null and empty texts have length 0; an empty table gives an empty
histogram; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND = 1024


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """``n_tokens`` and ``n_docs``: the documents of each length; a null length is 0."""
    return lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Answers for each context limit at which one changes: the distinct lengths.

    ``docs_over`` and ``tokens_over`` are the documents longer than the limit
    and all their tokens; ``tokens_kept`` is the total when every document is
    truncated to the limit, ``tokens_cut`` the rest of ``tokens_total``;
    ``share_within`` is the share of documents of at most that length, so the
    smallest limit with a share of p or more is the p-quantile.
    """
    rows = hist.withColumn("band", F.floor(F.col("n_tokens") / BAND))
    tokens = F.col("n_tokens") * F.col("n_docs")
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = rows.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    # a row for each band of lengths, so few that one task sums them
    bands = bands.select("band", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_beyond"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_beyond"), F.sum("d").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("docs_total"), F.sum("t").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("tokens_total"))
    inside = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(bands, "band").select(
        "n_tokens",
        "n_docs",
        "docs_total",
        "tokens_total",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_beyond")).alias("docs_over"),
        (F.coalesce(F.sum(tokens).over(inside), F.lit(0)) + F.col("tokens_beyond")).alias("tokens_over"),
    )
    kept = F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return summed.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_over",
        "tokens_over",
        kept.alias("tokens_kept"),
        (F.col("tokens_total") - kept).alias("tokens_cut"),
        "tokens_total",
        ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``tokens_kept`` and ``docs_over`` at any limits, from the next smaller distinct length (none: nothing fits but empty texts)."""
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    totals = sums.agg(F.max("tokens_total").alias("tokens_total"), F.max("docs_over").alias("most_over"), F.sum("n_docs").alias("docs"))
    # the limits are a short list of the caller's
    below = sums.join(F.broadcast(wanted), F.col("context_limit") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("docs_over", "tokens_over"), "context_limit").alias("x"))
    found = F.broadcast(wanted).join(below, "limit", "left").join(F.broadcast(totals))
    over = F.coalesce("x.docs_over", "docs")
    return found.select("limit", over.alias("docs_over"), (F.col("tokens_total") - F.coalesce("x.tokens_over", "tokens_total") + over * F.col("limit")).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least a share of the documents don't exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(wanted), F.col("share_within") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("length"))
