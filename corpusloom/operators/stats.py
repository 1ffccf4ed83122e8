"""Paired statistics. Resampling and ranks are spread over all tasks: no group has to fit one worker."""
from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import running_totals


def _poisson(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, (rows, draws), from a counter-based hash: the same for a row wherever it is processed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(steps, u).astype(np.float64)


def bootstrap_ci(values: DataFrame, by: list[str], key: str, value: str = "value", draws: int = 2000, level: float = 0.95, seed: int = 2024, interpolate: bool = True) -> DataFrame:
    """(by, mean, low, high, n): mean and percentile interval of each group by Poisson resampling.

    Each row draws its weight in every replicate by a hash of ``key``; tasks sum weighted values of all replicates of
    their rows, and the sums of a group, ``draws`` numbers, are added up. Nulls and NaN are left out; groups without
    values give no row; a single value is its own interval. Quantiles are interpolated linearly, or without
    ``interpolate`` the value at index int(q * draws) of the sorted means.
    """
    x = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.xxhash64(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    schema = ", ".join(f"{n} {t}" for n, t in x.dtypes if n in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            for g, rows in pdf.groupby(by, sort=False, dropna=False):
                for at in range(0, len(rows), 2048):
                    part = rows.iloc[at : at + 2048]
                    w, v = _poisson(part["_k"].to_numpy(np.int64).view(np.uint64), draws, seed), part["_v"].to_numpy()
                    s = held.setdefault(g, [np.zeros(draws), np.zeros(draws), 0.0, 0])
                    s[0] += v @ w
                    s[1] += w.sum(axis=0)
                    s[2] += float(v.sum())
                    s[3] += len(part)
        rows = [(*g, s[0].tolist(), s[1].tolist(), s[2], s[3]) for g, s in held.items()]
        yield pd.DataFrame(rows, columns=[*by, "sums", "weights", "total", "n"])

    p = x.mapInPandas(partial, f"{schema}, sums array<double>, weights array<double>, total double, n long")
    both = F.arrays_zip(F.col("sums").alias("s"), F.col("weights").alias("w"))
    each = p.select(*by, "total", "n", F.posexplode(both).alias("draw", "z")).select(*by, "draw", "z.*", F.when(F.col("draw") == 0, F.col("total")).alias("total"), F.when(F.col("draw") == 0, F.col("n")).alias("n"))
    each = each.groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    # a group's row holds one mean for each draw, however many tasks its values came from
    g = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.try_divide("s", "w"))).alias("m"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    g = g.select(*by, (F.col("total") / F.col("n")).alias("mean"), "n", "m")

    def quantile(q: float):
        if not interpolate:
            return F.get("m", F.least(F.floor(F.size("m") * F.lit(q)).cast("int"), F.size("m") - 1))
        at = (F.size("m") - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        a, b = F.get("m", lo), F.get("m", F.least(lo + 1, F.size("m") - 1))
        return a + (b - a) * (at - lo)

    one = lambda c: F.when(F.col("n") == 1, F.col("mean")).otherwise(c)
    return g.select(*by, "mean", one(quantile((1 - level) / 2)).alias("low"), one(quantile((1 + level) / 2)).alias("high"), "n")


def paired_bootstrap(pairs: DataFrame, by: list[str], key: str, a: str = "a", b: str = "b", **kw) -> DataFrame:
    """Interval of the mean of b - a; pairs with a null are left out."""
    return bootstrap_ci(pairs.withColumn("_d", F.col(b) - F.col(a)), by, key, "_d", **kw)


def small_bootstrap(values: list[float], draws: int = 2000, level: float = 0.95, seed: int = 2024) -> tuple[float, float, float]:
    """(mean, low, high) of a short list on the driver with numpy's generator, for comparison with other tools; an empty list is an error."""
    v = np.array([x for x in values if x is not None and not math.isnan(x)], dtype=float)
    if not len(v):
        raise ValueError("no values")
    if len(v) == 1:
        return float(v[0]), float(v[0]), float(v[0])
    rng = np.random.default_rng(seed)
    means = v[rng.integers(0, len(v), size=(draws, len(v)))].mean(axis=1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(v.mean()), float(low), float(high)


def cohen_d(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, mean_diff, cohen_d) of b - a: mean by sample deviation; null for fewer than two pairs or no spread."""
    d = F.col(b) - F.col(a)
    x = pairs.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return x.select(*by, "n", F.round("m", 6).alias("mean_diff"), F.when((F.col("n") >= 2) & (F.col("s") > 1e-12), F.round(F.col("m") / F.col("s"), 6)).alias("cohen_d"))


def signed_ranks(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, w_plus, w_minus, ties) of the differences b - a that are not 0, ranked by size with averaged ties.

    Distinct sizes are counted first and ranked by running totals over range partitions, so hot groups are split.
    """
    d = F.round(F.col(b) - F.col(a), 9)
    sizes = pairs.withColumn("_d", d).filter("_d != 0").groupBy(*by, F.abs("_d").alias("size")).agg(F.count("*").alias("cnt"), F.sum((F.col("_d") > 0).cast("long")).alias("up"))
    r = running_totals(sizes, by, ["size"], "cnt", "before").withColumn("rk", F.col("before") + (F.col("cnt") + 1) / 2.0)
    return r.groupBy(*by).agg(F.sum("cnt").alias("n"), F.sum(F.col("rk") * F.col("up")).alias("w_plus"), F.sum(F.col("rk") * (F.col("cnt") - F.col("up"))).alias("w_minus"), F.sum(F.col("cnt") * F.col("cnt") * F.col("cnt") - F.col("cnt")).alias("ties"))


def _signed_rank_p(n: int, w: float, ties: int) -> float | None:
    """Two-sided p of the smaller rank sum: exact up to 50 pairs without ties, else the normal approximation."""
    if n < 2:
        return None
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None


def wilcoxon(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, statistic, p) of the signed-rank test; p is null for fewer than two differences that are not 0."""
    r = signed_ranks(pairs, by, a, b)
    schema = ", ".join(f"{n} {t}" for n, t in r.dtypes if n in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["statistic"] = pdf[["w_plus", "w_minus"]].min(axis=1)
            pdf["p"] = pd.array([_signed_rank_p(int(n), w, int(t)) for n, w, t in zip(pdf["n"], pdf["statistic"], pdf["ties"])], dtype="Float64")
            yield pdf[[*by, "n", "statistic", "p"]]

    return r.mapInPandas(run, f"{schema}, n long, statistic double, p double")


def chi2_sf(x: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2))


def mcnemar(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(by, only_a, only_b, p, p_halved) of two boolean columns: exact binomial below 25 discordant pairs, else chi-squared.

    ``p`` is two-sided; ``p_halved`` is half of it in the chi-squared case, as some reports give it.
    """
    x = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.sum((F.col(a) & ~F.col(b)).cast("long")).alias("only_a"), F.sum((~F.col(a) & F.col(b)).cast("long")).alias("only_b"))
    schema = ", ".join(f"{n} {t}" for n, t in x.dtypes if n in by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ps, halves = [], []
            for u, v in zip(pdf["only_a"], pdf["only_b"]):
                n = int(u + v)
                if n < 25:
                    p = min(1.0, 2 * sum(math.comb(n, i) for i in range(int(min(u, v)) + 1)) / 2**n) if n else 1.0
                    ps.append(p)
                    halves.append(p)
                else:
                    p = chi2_sf((u - v) ** 2 / n)
                    ps.append(p)
                    halves.append(p / 2)
            pdf["p"], pdf["p_halved"] = ps, halves
            yield pdf

    return x.mapInPandas(run, f"{schema}, only_a long, only_b long, p double, p_halved double")


def list_bootstrap(values: list[float], draws: int = 2000, alpha: float = 0.05, seed: int = 13) -> dict | None:
    """mean, ci95_low, ci95_high and n of a short list on the driver, by Python's generator and index percentiles; null for an empty list."""
    if not values:
        return None
    rng, n = random.Random(seed), len(values)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(draws))
    return {"mean": sum(values) / n, "ci95_low": means[int(alpha / 2 * draws)], "ci95_high": means[int((1 - alpha / 2) * draws)], "n": n}
