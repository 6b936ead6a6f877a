"""Covariance estimation and portfolio allocation (M7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_shuffle, div
from ..functions.gram import pair_moments
from .risk import complete_dates, correlation, square


def centred_moments(returns: DataFrame, keys: list[str], chunk: Column, value: str = "r", blocks: int | None = None,
                    complete: bool = False) -> DataFrame:
    """Pair moments of returns minus the asset's mean, on complete dates."""
    d = returns if complete else complete_dates(returns, keys)
    m = d.groupBy(*keys, "asset").agg(F.avg(value).alias("_m"))
    d = d.join(m, [*keys, "asset"]).withColumn("x", F.col(value) - F.col("_m"))
    return pair_moments(d, keys, chunk, value="x", blocks=blocks)


def sample_covariance(moments: DataFrame, keys: list[str], periods: float = 252.0) -> DataFrame:
    c = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0.0))
    return moments.select(*keys, "a", "b", (c * periods).alias("value"))


def ledoit_wolf(moments: DataFrame, keys: list[str], periods: float = 252.0) -> DataFrame:
    """Shrinkage of the population covariance toward a scaled identity; the intensity comes from
    the same pair sums. Adds a ``shrinkage`` column."""
    c = F.col("sab") / F.col("n")
    diag = F.col("a") == F.col("b")
    twice = F.when(diag, 1.0).otherwise(2.0)
    s = moments.groupBy(*keys).agg(
        F.max("n").alias("_n"), F.sum(diag.cast("double")).alias("_p"), F.sum(F.when(diag, c)).alias("_tr"),
        F.sum(twice * c * c).alias("_d"), F.sum(twice * F.col("saabb")).alias("_b"))
    mu = F.col("_tr") / F.col("_p")
    delta = (F.col("_d") - 2 * mu * F.col("_tr") + F.col("_p") * mu * mu) / F.col("_p")
    beta = (F.col("_b") / F.col("_n") - F.col("_d")) / (F.col("_p") * F.col("_n"))
    s = s.select(*keys, mu.alias("_mu"), F.when(beta == 0, 0.0).otherwise(
        F.coalesce(F.least(beta, delta) / F.nullif(delta, F.lit(0.0)), F.lit(0.0))).alias("shrinkage"))
    if keys:
        j = moments.join(s, keys)
    else:
        j = moments.withColumn("_s", s.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
    v = (1 - F.col("shrinkage")) * c + F.when(diag, F.col("shrinkage") * F.col("_mu")).otherwise(0.0)
    return j.select(*keys, "a", "b", (v * periods).alias("value"), "shrinkage")


def covariance(returns: DataFrame, chunk: Column, method: str = "ledoit_wolf", keys=(), blocks: int | None = None) -> DataFrame:
    """(keys, a <= b, value): annualised covariance on complete dates."""
    keys = list(keys)
    m = centred_moments(returns, keys, chunk, blocks=blocks)
    return ledoit_wolf(m, keys).drop("shrinkage") if method == "ledoit_wolf" else sample_covariance(m, keys)


def psd_floor(cov: DataFrame, group: str, floor: float = 1e-6) -> DataFrame:
    """Raise the eigenvalues of each group's finished matrix to the floor."""
    types = dict(cov.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = square(pdf)
        e, v = np.linalg.eigh(m)
        if e[0] < floor:
            m = (v * np.maximum(e, floor)) @ v.T
        i, j = np.triu_indices(len(names))
        nm = np.array(names, dtype=object)
        return pd.DataFrame({group: pdf[group].iat[0], "a": nm[i], "b": nm[j], "value": m[i, j]})

    return cov.select(group, "a", "b", "value").groupBy(group).applyInPandas(
        run, f"`{group}` {types[group]}, a {types['a']}, b {types['b']}, value double")


def black_litterman(cov: DataFrame, views: DataFrame, group: str, delta: float = 2.5, tau: float = 0.05,
                    confidence: float = 0.5) -> DataFrame:
    """(group, asset, pi, mu): equilibrium and posterior returns; ``views`` holds (group, asset, q, w_mkt),
    a missing view repeats the equilibrium, missing market weights are equal."""
    types = dict(cov.dtypes)
    v = views.select(group, F.col("asset").alias("a"), F.col("q").cast("double").alias("q"), F.col("w_mkt").cast("double").alias("w_mkt"))
    entries = cov.select(group, "a", "b", "value").join(v, [group, "a"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = square(pdf)
        n = len(names)
        own = pdf[pdf["a"] == pdf["b"]].drop_duplicates("a").set_index("a").reindex(names)
        w = own["w_mkt"].fillna(1.0 / n).to_numpy(float)
        pi = delta * (s @ (w / w.sum()))
        q = own["q"].to_numpy(float)
        q = np.where(np.isnan(q), pi, q)
        ts = tau * s
        omega = np.diag(np.diag(ts)) / max(confidence, 0.01)
        # inv(inv(A) + inv(O)) (inv(A) pi + inv(O) q) = pi + A inv(A + O) (q - pi)
        mu = pi + ts @ np.linalg.solve(ts + omega, q - pi)
        return pd.DataFrame({group: pdf[group].iat[0], "asset": names, "pi": pi, "mu": mu})

    return entries.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, asset {types['a']}, pi double, mu double")


def candidate_portfolio_scoring(weights: DataFrame, mu: DataFrame, cov: DataFrame, risk_free: float = 0.04,
                                max_weight: float = 0.40, keys=(), candidate: str = "candidate") -> DataFrame:
    """Expected return, volatility and Sharpe of every candidate that is long-only, within the cap and
    fully invested; ``best_rank`` 1 is the highest Sharpe."""
    keys = list(keys)
    ok = weights.groupBy(*keys, candidate).agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.sum("w").alias("t")).where(
        (F.col("lo") >= 0) & (F.col("hi") <= max_weight) & (F.abs(F.col("t") - 1) < 1e-9)).select(*keys, candidate)
    w = weights.join(by_shuffle(ok), [*keys, candidate], "left_semi")
    both = cov.select(*keys, F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("e"), "value").select(*keys, "e.a", "e.b", "value")
    left = w.select(*keys, candidate, F.col("asset").alias("a"), "w").join(both, [*keys, "a"]).groupBy(*keys, candidate, "b").agg(
        F.sum(F.col("w") * F.col("value")).alias("sw"))
    risk = left.join(by_shuffle(w.select(*keys, candidate, F.col("asset").alias("b"), "w")), [*keys, candidate, "b"]).groupBy(*keys, candidate).agg(
        F.sqrt(F.greatest(F.sum(F.col("w") * F.col("sw")), F.lit(0.0))).alias("expected_volatility"))
    ret = w.join(mu.select(*keys, "asset", "mu"), [*keys, "asset"]).groupBy(*keys, candidate).agg(F.sum(F.col("w") * F.col("mu")).alias("expected_return"))
    d = ret.join(by_shuffle(risk), [*keys, candidate]).withColumn(
        "sharpe_ratio", F.coalesce(div(F.col("expected_return") - risk_free, "expected_volatility"), F.lit(0.0)))
    if keys:
        best = d.groupBy(*keys).agg(F.min_by(candidate, F.struct(F.coalesce(-F.col("sharpe_ratio"), F.lit(float("inf"))), candidate)).alias("_best"))
        return d.join(best, keys).withColumn("best", F.col(candidate) == F.col("_best")).drop("_best")
    best = d.agg(F.min_by(candidate, F.struct(F.coalesce(-F.col("sharpe_ratio"), F.lit(float("inf"))), candidate)).alias("_best"))
    return d.withColumn("best", F.col(candidate) == best.scalar())


def _single_linkage_order(dist: np.ndarray) -> list[int]:
    """Leaf order of the single-linkage tree (left child first)."""
    n = len(dist)
    inside, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, cur = [], 0
    for _ in range(n - 1):  # minimum spanning tree
        inside[cur] = True
        closer = ~inside & (dist[cur] < best)
        best[closer], parent[closer] = dist[cur][closer], cur
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[nxt], parent[nxt], nxt))
        cur = nxt
    root = {i: i for i in range(n)}  # member -> cluster id
    members = {i: [i] for i in range(n)}
    for k, (_, i, j) in enumerate(sorted(edges, key=lambda e: e[0])):
        a, b = sorted((root[i], root[j]))
        members[n + k] = members.pop(a) + members.pop(b)
        for x in members[n + k]:
            root[x] = n + k
    return next(iter(members.values()))


def _bisect(order: list[int], s: np.ndarray) -> np.ndarray:
    w = np.ones(len(s))
    stack = [order]
    while stack:
        items = stack.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2:]
        var = []
        for part in (left, right):
            c = s[np.ix_(part, part)]
            iv = 1.0 / np.diag(c)
            iv /= iv.sum()
            var.append(iv @ c @ iv)
        alpha = 1 - var[0] / (var[0] + var[1]) if var[0] + var[1] > 0 else 0.5
        w[left] *= alpha
        w[right] *= 1 - alpha
        stack += [left, right]
    return w


def hrp_weights(cov: DataFrame, corr: DataFrame, group: str) -> DataFrame:
    """Hierarchical risk parity per group from its finished covariance and correlation entries."""
    types = dict(cov.dtypes)
    entries = cov.select(group, "a", "b", "value").join(corr.select(group, "a", "b", "corr"), [group, "a", "b"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = square(pdf)
        n = len(names)
        if n < 2:
            return pd.DataFrame({group: pdf[group].iat[0], "asset": names, "w": [1.0 / n] * n})
        rho = np.nan_to_num(square(pdf, "corr")[1])
        np.fill_diagonal(rho, 1.0)
        dist = np.sqrt(np.clip((1 - rho) / 2, 0, 1))
        return pd.DataFrame({group: pdf[group].iat[0], "asset": names, "w": _bisect(_single_linkage_order(dist), s)})

    return entries.groupBy(group).applyInPandas(run, f"`{group}` {types[group]}, asset {types['a']}, w double")


def score_views(scores: DataFrame) -> DataFrame:
    """Expected return from a 0-100 score: 50 is 8 %, 100 is 18 %, 0 is -2 %."""
    return scores.withColumn("q", 0.08 + (F.coalesce("score", F.lit(50.0)) - 50.0) / 50.0 * 0.10)


def allocate(returns: DataFrame, scores: DataFrame, chunk: Column, group: str) -> DataFrame:
    """Covariance -> score views -> Black-Litterman, and hierarchical risk parity, per group."""
    m = centred_moments(returns, [group], chunk)
    cov = psd_floor(ledoit_wolf(m, [group]), group)
    assets = cov.where("a = b").select(group, F.col("a").alias("asset"))
    views = score_views(assets.join(scores, "asset", "left")).withColumn("w_mkt", F.lit(None).cast("double"))
    bl = black_litterman(cov, views, group)
    hrp = hrp_weights(cov, correlation(m, [group]), group)
    return bl.join(hrp, [group, "asset"])
