"""Paired comparisons: bootstrap intervals, sign-flip tests, step-down adjustment, decisions.

Resampling is done by hashing, so that it is reproducible, needs no order and no gathering: each pair draws a
Poisson(1) weight (bootstrap) or a sign (permutation) per replicate, and replicates are sums of map-side partial sums.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that an exact replay of a generator's draws may hold in one task; larger comparisons use the hashed form.
MAX_REPLAY = 1_000_000
#: Cumulative probabilities of Poisson(1) for 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def poisson(u: Column) -> Column:
    out = F.lit(len(POISSON))
    for n in reversed(range(len(POISSON))):
        out = F.when(u < POISSON[n], n).otherwise(out)
    return out


def paired(df: DataFrame, key: str, condition: str, value: str, hi: str, lo: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, key, hi, lo, diff) of the instances that both conditions have; one aggregation, no self-join."""
    of = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    both = df.filter(F.col(condition).isin(hi, lo)).groupBy(*keys, key).agg(of(hi).alias("hi"), of(lo).alias("lo")).filter("hi is not null and lo is not null")
    return both.withColumn("diff", F.col("hi") - F.col("lo"))


def bootstrap(pairs: DataFrame, key: str, n_boot: int, seed: int, keys: tuple[str, ...] = (), level: float = 0.95) -> DataFrame:
    """(keys, n, mean, lo, hi): the mean difference and its percentile interval."""
    b = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")
    drawn = pairs.select(*keys, key, "diff", b).withColumn("w", poisson(uniform(F.lit(seed), F.col("b"), F.col(key))))
    means = drawn.groupBy(*keys, "b").agg(F.try_divide(F.sum(F.col("w") * F.col("diff")), F.sum("w")).alias("m"))
    a = (1 - level) / 2
    ci = means.groupBy(*keys).agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi"))
    obs = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("diff").alias("mean"))
    return obs.join(ci, list(keys)) if keys else obs.crossJoin(F.broadcast(ci))  # one row each


def sign_flip(pairs: DataFrame, key: str, n_perm: int, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, p_value): two-sided, (count + 1) / (n_perm + 1) of sign-flipped means at least as far from 0 as observed."""
    b = F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b")
    flipped = pairs.select(*keys, key, "diff", b).withColumn("s", F.when(uniform(F.lit(seed), F.col("b"), F.col(key)) < 0.5, -F.col("diff")).otherwise(F.col("diff")))
    means = flipped.groupBy(*keys, "b").agg(F.avg("s").alias("m"), F.avg("diff").alias("obs"))
    far = F.count_if(F.abs("m") >= F.abs("obs") - 1e-12)
    return means.groupBy(*keys).agg(((far + 1) / (n_perm + 1)).alias("p_value"))


def holm(tests: DataFrame, p: str, *keys: str, level: float = 0.05, tie: str = "name") -> DataFrame:
    """Adds p_holm and ``reject`` by Holm's step-down within each family; null p-values pass through."""
    real = tests.filter(F.col(p).isNotNull())
    fam = Window.partitionBy(*keys)
    w = fam.orderBy(p, tie)
    step = F.least(F.lit(1.0), (F.count("*").over(fam) - F.row_number().over(w) + 1) * F.col(p))
    done = real.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    done = done.withColumn("reject", F.col("p_holm") < level)
    rest = tests.filter(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")).withColumn("reject", F.lit(False))
    return done.unionByName(rest)


def claim(supported: Column, uptake: Column | None = None, least_uptake: float = 0.9) -> Column:
    """Decision over an array of booleans: all, some or none of the structural tests passed; too little uptake decides nothing."""
    out = F.when(F.forall(supported, lambda x: x), "Supported").when(F.exists(supported, lambda x: x), "Mixed").otherwise("Not supported")
    return out if uptake is None else F.when(F.coalesce(uptake, F.lit(0.0)) < least_uptake, "Inconclusive uptake").otherwise(out)


def gate(diff: Column, lo: Column, violations: Column, least: float = 0.05) -> Column:
    return (diff >= least) & (lo > 0) & (violations == 0)


def replay(pairs: DataFrame, n_boot: int, seed: int, keys: tuple[str, ...], order: str, interpolate: bool = True, perm_seed: int | None = None) -> DataFrame:
    """Interval and p-value with the draws of numpy's ``default_rng(seed)``, pairs in ``order``.

    A replay is sequential and holds a comparison in one task; comparisons beyond MAX_REPLAY pairs raise an error and
    are to be made with ``bootstrap`` and ``sign_flip``.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MAX_REPLAY:
            raise ValueError(f"{len(g)} pairs: use the hashed resampling")
        x = g.sort_values(order)["diff"].to_numpy()
        n, rng = len(x), np.random.default_rng(seed)
        means = np.sort([x[rng.integers(0, n, n)].mean() for _ in range(n_boot)])
        if interpolate:
            lo, hi = np.quantile(means, [0.025, 0.975])
        else:
            lo, hi = means[int(0.025 * n_boot)], means[min(n_boot - 1, int(0.975 * n_boot))]
        rng = np.random.default_rng(seed if perm_seed is None else perm_seed)
        flips = np.array([(x * rng.choice([-1.0, 1.0], n)).mean() for _ in range(n_boot)])
        p = (np.sum(np.abs(flips) >= abs(x.mean()) - 1e-12) + 1) / (n_boot + 1)
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), n, x.mean(), lo, hi, p]], columns=[*keys, "n", "mean", "lo", "hi", "p_value"])

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, mean double, lo double, hi double, p_value double"
    return pairs.groupBy(*keys).applyInPandas(one, schema)


def replay_plain(pairs: DataFrame, n_boot: int, seed: int, keys: tuple[str, ...], order: str) -> DataFrame:
    """(keys, n, mean, lo, hi) with the draws of ``random.Random(seed)``, pairs in ``order``; bounds as in ``replay``."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > MAX_REPLAY:
            raise ValueError(f"{len(g)} pairs: use the hashed resampling")
        x = g.sort_values(order)["diff"].tolist()
        n, rng = len(x), random.Random(seed)
        means = sorted(sum(x[rng.randrange(n)] for _ in range(n)) / n for _ in range(n_boot))
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), n, sum(x) / n, means[int(0.025 * n_boot)], means[min(n_boot - 1, int(0.975 * n_boot))]]], columns=[*keys, "n", "mean", "lo", "hi"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, mean double, lo double, hi double")


def trend(doses: DataFrame, dose: str, value: str, keys: tuple[str, ...], n_perm: int, seed: int) -> DataFrame:
    """Spearman correlation of dose and value per comparison, with a permutation p-value; ties take the last place.

    A comparison has a few doses; the group handed to a task is one row per dose.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        last = lambda v: pd.Series(v).rank(method="max").to_numpy()
        rho = lambda a, b: 0.0 if len(a) < 2 or a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])
        g = g.sort_values([dose, value])
        a, b = last(g[dose]), last(g[value])
        obs, rng = rho(a, b), np.random.default_rng(seed)
        far = sum(abs(rho(a, rng.permutation(b))) >= abs(obs) - 1e-12 for _ in range(n_perm))
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), len(g), obs, (far + 1) / (n_perm + 1)]], columns=[*keys, "n", "rho", "p_value"])

    kinds = dict(doses.dtypes)
    mean = doses.groupBy(*keys, dose).agg(F.avg(value).alias(value))
    return mean.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n bigint, rho double, p_value double")
