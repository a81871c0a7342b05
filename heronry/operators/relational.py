"""Relational building blocks of the evaluation pipelines, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.session import materialise


def order_of(*cols: str) -> list[Column]:
    """Sort columns; a leading minus means descending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in cols]


def keep_first(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order_of(*order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    return keep_first(df, keys, *[c[1:] if c.startswith("-") else f"-{c}" for c in order])


def ranked(df: DataFrame, keys: Sequence[str], *order: str, name: str = "rank") -> DataFrame:
    """1-based rank within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_of(*order))).cast("int"))


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: str, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark keeps k rows per key and task before the shuffle."""
    return ranked(df, keys, *order, name=name).filter(F.col(name) <= k)


def scan_then_keep(df: DataFrame, keys: Sequence[str], depth: int, keep: Column, k: int, *order: str) -> DataFrame:
    """The first k rows that satisfy ``keep`` among the first ``depth`` of each key."""
    return top_k(top_k(df, keys, depth, *order, name="_deep").filter(keep).drop("_deep"), keys, k, *order)


def global_rank(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """0-based position in the total order of a table, without gathering it in one task.

    The table is cut into ranges of the order and each range sorted; a row's position is its place in its range plus
    the sizes of the ranges before. The sorted table is checkpointed, so that both passes see the same ranges.
    """
    cut = materialise(df.repartitionByRange(*order_of(*order)).sortWithinPartitions(*order_of(*order)))
    marked = cut.withColumn("_at", F.monotonically_increasing_id())
    sizes = marked.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row per range
    here = marked.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_part"))
    return here.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_at", "_part", "_before")


def nearest(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(anchor, near, rank): the k other rows nearest to each row by (gap of ``value``, ``key``), whatever the density.

    Values are compared to six digits; null is near nothing. The k distinct values on either side in the total order hold
    all that can be nearest, each with its first k + 1 keys, one of which may be the row itself.
    """
    rows = df.select(F.col(key).alias("anchor"), F.round(value, 6).alias("_v")).filter("_v is not null")
    held = top_k(rows, ["_v"], k + 1, "anchor", name="_n").groupBy("_v").agg(F.collect_list("anchor").alias("_keys"))
    at = global_rank(held, "_v", name="_place")
    reach = at.select(F.col("_v").alias("_own"), F.explode(F.sequence(F.col("_place") - k, F.col("_place") + k)).alias("_place"))
    gap = reach.join(at, "_place").select("_own", F.explode("_keys").alias("near"), F.round(F.abs(F.col("_v") - F.col("_own")), 6).alias("_gap"))
    best = top_k(gap, ["_own"], k + 1, "_gap", "near", name="_n").drop("_n")
    pairs = rows.join(best, F.col("_v") == F.col("_own")).filter("anchor <> near")
    return top_k(pairs, ["anchor"], k, "_gap", "near").select("anchor", "near", "rank")


def shard(df: DataFrame, n: int, i: int, *order: str) -> DataFrame:
    """Every n-th row of the total order, from the i-th."""
    return global_rank(df, *order).filter(F.col("position") % n == i).drop("position")


def rank_split(df: DataFrame, cuts: Sequence[tuple[str, float]], rest: str, *order: str) -> DataFrame:
    """``split`` by rank fraction: the first floor(n*f) rows of the total order belong to the first name, and so on."""
    n = df.count()
    out = F.lit(rest)
    for name, f in reversed(cuts):
        out = F.when(F.col("position") < int(n * f), name).otherwise(out)
    return global_rank(df, *order).withColumn("split", out).drop("position")


def seeded_key(seed: int, *cols: str) -> Column:
    """A reproducible shuffle key."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))), 256)


def seeded_sample(df: DataFrame, n: int, seed: int, *cols: str) -> DataFrame:
    """n rows by the shuffle key: a top-n, never a full sort in one task."""
    return df.withColumn("_key", seeded_key(seed, *cols)).orderBy("_key", *cols).limit(n).drop("_key")


def seeded_pick(df: DataFrame, keys: Sequence[str], value: str, seed: int) -> DataFrame:
    """One value per key, picked by hash: pre-aggregated, so that a hot key is no hot task."""
    h = seeded_key(seed, *keys, value)
    return df.groupBy(*keys).agg(F.min_by(value, h).alias(value))


def prefix_clusters(df: DataFrame, cluster: str, fraction: float, *order: str) -> DataFrame:
    """Whole clusters in order, until at least ``fraction`` of all rows are taken. The running sum is over clusters."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order_of(*order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("*", before.alias("taken_before"), total.alias("total")).filter(F.col("taken_before") < fraction * F.col("total")).drop("total")


def share(df: DataFrame, count: str, *keys: str) -> Column:
    """A row's part of its group's total."""
    return F.col(count) / F.sum(count).over(Window.partitionBy(*keys))


def upper_median(value: str) -> Column:
    """The element at n div 2 of the sorted values, without gathering them: a discrete percentile."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def entropy(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Base-2 entropy of a value's distribution per key, from counts; nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*keys, (F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each filter of a sequence, in one pass."""
    passed, aggs = F.lit(True), []
    for name, cond in stages:
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(n).alias("n")) for i, (n, _) in enumerate(stages)])
    return one.select(F.inline(pairs))


def padded(first: Column, second: Column, k: int) -> Column:
    """``first`` and what ``second`` adds, in order, to k elements."""
    return F.slice(F.array_distinct(F.concat(first, second)), 1, k)


def budget_fold(items: Column, cost: str, budget: int) -> Column:
    """Walks an array of structs and accepts an element only if it still fits; what doesn't fit is skipped, not the end."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("accepted"), F.lit(0).alias("skipped"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x[cost] <= budget
        return F.struct(
            (acc["used"] + F.when(fits, x[cost]).otherwise(0)).cast("bigint").alias("used"),
            (acc["accepted"] + fits.cast("int")).alias("accepted"),
            (acc["skipped"] + (~fits).cast("int")).alias("skipped"),
        )

    return F.aggregate(items, zero, step)


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of the rules that a row breaks, joined by |; empty if it breaks none."""
    return F.concat_ws("|", *[F.when(broken, code) for code, broken in rules])
