"""Tests and ranks.  Exact where a Catalyst expression can be; resampling in grouped Python with a seed per group."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p for discordant counts b and c: min(1, 2 * P(X <= min)) for a fair binomial; 1 without any."""
    n, m = (b + c).cast("double"), F.least(b, c)
    # Terms as logs, so large counts do not underflow: log C(n,k) grows by log((n-k+1)/k).
    start = F.struct((n * F.log(F.lit(0.5))).alias("t"), F.exp(n * F.log(F.lit(0.5))).alias("s"))
    ks = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(ks, start, lambda a, k: F.struct((a["t"] + F.log((n - k + 1) / k)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - k + 1) / k))).alias("s")), lambda a: a["s"])
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def average_rank(value: str, *partition: str) -> Column:
    """Ranks with ties at their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(value)) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """n and rho by group; null where a variance is 0."""
    ranked = df.withColumn("__x", average_rank(x, *by)).withColumn("__y", average_rank(y, *by))
    return pearson(ranked, "__x", "__y", *by).withColumnRenamed("r", "rho")


def pearson(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    # Not corr(), which divides by zero where a variance is 0, whatever stands around it.
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), r.alias("r"))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    return (rxy - rxz * ryz) / F.sqrt(F.greatest(F.lit(1e-12), (1 - rxz * rxz) * (1 - ryz * ryz)))


def nearest_rank(value: str, q: float) -> Column:
    """The value at position ceil(n q)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def partial_spearman(df: DataFrame, x: str, y: str, z: str, *by: str) -> DataFrame:
    """n and rho of x and y with z held fixed, by group, over average ranks; null where a variance is 0 or n is 2 or less."""
    ranked = df.select(*by, *(average_rank(c, *by).alias(c) for c in (x, y, z)))

    def r(a: str, b: str) -> Column:
        return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))

    rho = partial(r(x, y), r(x, z), r(y, z))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") > 2, rho).alias("rho"))


def _seed(seed: int, key: object) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big")


def bootstrap_mean(df: DataFrame, by: str, value: str, draws: int = 10_000, seed: int = 13) -> DataFrame:
    """Mean and 95 % interval of per-graph values by group; each group has its own stream.

    df has one row per graph: few enough for one task, as the resampling needs them together.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(group[value].to_numpy(float))
        rng = np.random.default_rng(_seed(seed, group[by].iloc[0]))
        means = np.concatenate([v[rng.integers(0, len(v), (min(1000, draws - at), len(v)))].mean(1) for at in range(0, draws, 1000)])
        lo, hi = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({by: [group[by].iloc[0]], "n": [len(v)], "mean": [v.mean()], "ci_low": [lo], "ci_high": [hi]})

    kind = dict(df.dtypes)[by]
    return df.select(by, value).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, mean double, ci_low double, ci_high double")


#: Rows of a group that one task draws from, on average.
SHARD = 20_000


def permutation_p(df: DataFrame, by: str, value: str, high: str, draws: int = 10_000, seed: int = 13, shard: int = SHARD) -> DataFrame:
    """Two-sided p of the difference of means between high and other rows, (hits + 1) / (draws + 1); null if a side is empty.

    Groups of more than shard rows are cut by hash of the value.  A permutation's first rows
    are a random subset: how many of each shard are in it is drawn from the multivariate
    hypergeometric distribution, and then each shard draws so many of its own rows.
    df is read more than once and so must be a table or cheap.
    """
    from ..sources.shared import written

    kind = dict(df.dtypes)[by]
    rows = written(df.sparkSession, df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.col(high).alias("h")))
    sizes = rows.groupBy(F.col("g").alias("own")).agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    same = F.col("g").eqNullSafe(F.col("own"))
    cut = rows.join(sizes.filter("shards > 1"), same).select("g", "v", "h", F.pmod(F.xxhash64("v"), F.col("shards")).alias("shard"))
    # One row a value: a value that many rows share is drawn by its count.
    cells = written(df.sparkSession, cut.groupBy("g", "shard", "v").agg(F.count("*").alias("n"), F.count_if("h").alias("top")))
    small = rows.join(sizes.filter("shards = 1"), same).select("g", "v", "h")
    whole = small.withColumnsRenamed({"g": by, "v": value, "h": high}).groupBy(by).applyInPandas(_permuted(by, value, high, draws, seed), f"{by} {kind}, n long, p double")

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        rng = np.random.default_rng(_seed(seed, group["g"].iloc[0]))
        drawn = rng.multivariate_hypergeometric(group["n"].to_numpy(np.int64), int(group["top"].sum()), draws, method="marginals")
        return pd.DataFrame({"g": group["g"], "shard": group["shard"], "take": [drawn[:, i].tolist() for i in range(len(group))]})

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        v, n, g, at = group["v"].to_numpy(float), group["n"].to_numpy(np.int64), group["g"].iloc[0], group["shard"].iloc[0]
        rng, take = np.random.default_rng(_seed(seed, f"{g}:{at}")), next(x for x in group["take"] if x is not None)
        if n.sum() > 8 * len(v):  # few values, each with its count
            sums = [float(rng.multivariate_hypergeometric(n, k, method="marginals") @ v) for k in take]
        else:
            each = np.repeat(v, n)
            sums = [float(rng.permutation(each)[:k].sum()) for k in take]
        return pd.DataFrame({"g": [g], "shard": [at], "n": [int(n.sum())], "total": [float(v @ n)], "top": [int(group["top"].sum())], "seen": [float(v @ group["top"].to_numpy(float))], "sums": [sums]})

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        n, top, total = int(group["n"].sum()), int(group["top"].sum()), float(group["total"].sum())
        p = None
        if 0 < top < n:
            gap = lambda s: abs(s / top - (total - s) / (n - top))
            hits = int((gap(np.sum(np.stack(group["sums"].to_list()), axis=0)) >= gap(float(group["seen"].sum())) - 1e-12).sum())
            p = (hits + 1) / (draws + 1)
        return pd.DataFrame({by: [group["g"].iloc[0]], "n": [n], "p": pd.array([p], dtype="Float64")})

    shards = cells.groupBy("g", "shard").agg(F.sum("n").alias("n"), F.sum("top").alias("top"))
    taken = shards.groupBy("g").applyInPandas(deal, f"g {kind}, shard long, take array<long>")
    take = taken.select(F.col("g").alias("tg"), F.col("shard").alias("ts"), "take")
    # A shard's list of takes stands in its first row only.
    ranked = cells.withColumn("no", F.row_number().over(Window.partitionBy("g", "shard").orderBy("v")))
    asked = ranked.join(take, F.col("g").eqNullSafe(F.col("tg")) & (F.col("shard") == F.col("ts")) & (F.col("no") == 1), "left").select("g", "shard", "v", "n", "top", "take")
    summed = asked.groupBy("g", "shard").applyInPandas(draw, f"g {kind}, shard long, n long, total double, top long, seen double, sums array<double>")
    return whole.unionByName(summed.groupBy("g").applyInPandas(decide, f"{by} {kind}, n long, p double"))


def _permuted(by: str, value: str, high: str, draws: int, seed: int):
    """The test of one group that fits a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([high, value])
        v, top = group[value].to_numpy(float), int(group[high].sum())
        p = None
        if 0 < top < len(v):
            mask = group[high].to_numpy(bool)
            seen = abs(v[mask].mean() - v[~mask].mean())
            rng = np.random.default_rng(_seed(seed, group[by].iloc[0]))
            hits = 0
            for _ in range(draws):
                s = rng.permutation(v)
                hits += abs(s[:top].mean() - s[top:].mean()) >= seen - 1e-12
            p = (hits + 1) / (draws + 1)
        return pd.DataFrame({by: [group[by].iloc[0]], "n": [len(v)], "p": pd.array([p], dtype="Float64")})

    return run
