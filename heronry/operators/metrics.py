"""Ranking metrics on long frames: ranked (query, doc, rank), gold (query, doc)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked rows with ``hit`` and the number of gold documents of their query (0 if it has none)."""
    g = gold.select("query", "doc").distinct()
    n = g.groupBy("query").agg(F.count("*").alias("n_gold"))
    j = ranked.select("query", "doc", "rank").join(g.withColumn("hit", F.lit(True)), ["query", "doc"], "left")
    return j.join(n, "query", "left").select("query", "doc", "rank", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"))


def evaluate(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Per ranked query: mrr, top1, r_precision and, for each k, recall, hit, ndcg, ap, set_f1 and oracle-normalised recall.

    An empty gold set gives 0 everywhere. All are conditional sums of one aggregation per query.
    """
    h = hits(ranked, gold)
    running = F.sum(F.col("hit").cast("int")).over(Window.partitionBy("query").orderBy("rank"))
    h = h.withColumn("precision", running / F.col("rank"))
    n = F.first("n_gold")
    at = lambda k, v: F.sum(F.when(F.col("hit") & (F.col("rank") <= k), v).otherwise(0.0))
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = [
        F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.max((F.col("hit") & (F.col("rank") == 1)).cast("int")).alias("top1"),
        share(F.sum(F.when(F.col("hit") & (F.col("rank") <= F.col("n_gold")), 1.0).otherwise(0.0)), n).alias("r_precision"),
    ]
    for k in ks:
        got = at(k, F.lit(1.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1))
        out += [
            share(got, n).alias(f"recall_{k}"),
            (got > 0).cast("int").alias(f"hit_{k}"),
            F.when(n > 0, at(k, 1.0 / F.log2(F.col("rank") + 1)) / ideal).otherwise(0.0).alias(f"ndcg_{k}"),
            share(at(k, F.col("precision")), F.least(n, F.lit(k))).alias(f"ap_{k}"),
            share(2 * got, F.lit(k) + n).alias(f"set_f1_{k}"),
            share(got, F.least(n, F.lit(k))).alias(f"oracle_recall_{k}"),
        ]
    return h.groupBy("query").agg(*out)


def tolerant_recall(ranked: DataFrame, gold: DataFrame, k: int, reach: int = 1) -> DataFrame:
    """Recall of gold indices by ranked indices at most ``reach`` away: an equi-join on the indices within reach."""
    g = gold.select("query", F.col("doc").alias("gold")).distinct()
    near = ranked.filter(F.col("rank") <= k).select("query", F.explode(F.sequence(F.col("doc") - reach, F.col("doc") + reach)).alias("gold")).distinct()
    found = g.join(near.withColumn("found", F.lit(1)), ["query", "gold"], "left")
    return found.groupBy("query").agg(F.avg(F.coalesce("found", F.lit(0)).cast("double")).alias("tolerant_recall"))
