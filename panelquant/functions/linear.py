"""Least squares from mergeable centred moments.

A regression needs the count, the means and the co-moments around them. Spark builds those per group or window with
aggregates whose partial results merge around a common mean, so a high level of the data costs no digits. The small systems are solved
many at a time: an Arrow batch of rows is a stack of k-by-k matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIVOT = 1e-12  # of a system scaled to a unit diagonal; below it the system counts as singular


def moment_names(k: int) -> list[str]:
    """Count, means, co-moments (per row of data) of k regressors and y, which is the last."""
    return ["_n", *[f"_m_{i}" for i in range(k + 1)], *[f"_c_{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]]


def moment_columns(y: str, xs: list[str], over=None) -> list[Column]:
    """Moments for a regression of y on a constant and xs (complete rows only), per group or over a window."""
    names = [*xs, y]
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    v = [F.when(ok, F.col(n).cast("double")) for n in names]
    cols = [F.count(F.when(ok, 1)), *[F.avg(x) for x in v]]
    cols += [F.covar_pop(v[i], v[j]) for i in range(len(v)) for j in range(i, len(v))]
    return [(c.over(over) if over is not None else c).cast("double").alias(n) for c, n in zip(cols, moment_names(len(xs)), strict=True)]


def merged_columns(k: int, over, whole) -> list[Column]:
    """Moments of all rows of a window of moments. Means are taken from their mean over the window ``whole``, so what is squared is small."""
    n = F.sum("_n").over(over)
    ref = [F.avg(f"_m_{i}").over(whole) for i in range(k + 1)]
    d = [F.col(f"_m_{i}") - r for i, r in enumerate(ref)]
    shift = [F.sum(F.col("_n") * x).over(over) / n for x in d]
    cols = [n, *[r + s for r, s in zip(ref, shift, strict=True)]]
    cols += [F.sum(F.col("_n") * (F.col(f"_c_{i}_{j}") + d[i] * d[j])).over(over) / n - shift[i] * shift[j]
             for i in range(k + 1) for j in range(i, k + 1)]
    return [c.alias(name) for c, name in zip(cols, moment_names(k), strict=True)]


def stacked(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, means, symmetric co-moments) of a batch of rows; y is the last of k + 1."""
    data = pdf[moment_names(k)].to_numpy(float)
    n, mean = np.nan_to_num(data[:, 0]), data[:, 1:k + 2]
    c = np.empty((len(data), k + 1, k + 1))
    i, j = np.triu_indices(k + 1)
    c[:, i, j] = c[:, j, i] = data[:, k + 2:]
    return n, mean, c


def cholesky_stack(a: np.ndarray, pivot: float = PIVOT) -> tuple[np.ndarray, np.ndarray]:
    """Lower factors of a stack of symmetric matrices and which of them have one; columns run over the whole stack at once."""
    low, good = np.zeros_like(a), np.ones(len(a), bool)
    for j in range(a.shape[1]):
        d = a[:, j, j] - (low[:, j, :j] ** 2).sum(1)
        good &= d > pivot
        low[:, j, j] = root = np.sqrt(np.where(d > pivot, d, 1.0))
        low[:, j + 1:, j] = (a[:, j + 1:, j] - np.einsum("nik,nk->ni", low[:, j + 1:, :j], low[:, j, :j])) / root[:, None]
    return low, good


def inverse_stack(a: np.ndarray) -> np.ndarray:
    """Inverses of a stack of symmetric matrices, pseudo-inverses where they are singular."""
    scale = np.sqrt(np.einsum("nii->ni", a))
    scale = np.where(scale > 0, scale, 1.0)
    outer = scale[:, :, None] * scale[:, None, :]
    unit = a / outer
    low, good = cholesky_stack(unit)
    k = a.shape[1]
    inv_low = np.zeros_like(a)  # of the lower factors, row by row
    for i in range(k):
        row = -np.einsum("nk,nkj->nj", low[:, i, :i], inv_low[:, :i])
        row[:, i] += 1.0
        inv_low[:, i] = row / low[:, i, i, None]
    out = np.einsum("nki,nkj->nij", inv_low, inv_low)
    if not good.all():
        out[~good] = np.linalg.pinv(unit[~good], rcond=PIVOT, hermitian=True)
    return out / outer


def solve_stack(n: np.ndarray, mean: np.ndarray, c: np.ndarray, use: list[int] | None = None):
    """(coefficients with the constant first, standard errors, r2) of a stack of regressions; ``use`` picks the regressors kept.

    Regressors that don't vary, or that others determine, get the least coefficients that fit."""
    use = list(range(c.shape[1] - 1)) if use is None else use
    cxx, cxy, cyy = c[:, use][:, :, use], c[:, use, -1], c[:, -1, -1]
    inv = inverse_stack(cxx)
    b = np.einsum("nij,nj->ni", inv, cxy)
    mx = mean[:, use]
    coef = np.column_stack([mean[:, -1] - (b * mx).sum(1), b])
    with np.errstate(divide="ignore", invalid="ignore"):
        sse = n * np.maximum(cyy - (b * cxy).sum(1), 0.0)
        r2 = np.where(cyy > 0, 1 - sse / (n * cyy), np.nan)
        dof = n - len(use) - 1
        s2 = np.where(dof > 0, sse / dof, np.nan) / n
        se = np.sqrt(np.maximum(np.column_stack([1 + np.einsum("ni,nij,nj->n", mx, inv, mx), np.einsum("nii->ni", inv)]), 0) * s2[:, None])
    return coef, se, r2


def t_two_sided(t, dof):
    """Two-sided p-values of Student's t for integer degrees of freedom (finite series)."""
    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof))
    out = np.full(t.shape, np.nan)
    for d in np.unique(dof[(dof >= 1) & np.isfinite(t)]).astype(int):
        at = (dof == d) & np.isfinite(t)
        theta = np.arctan(np.abs(t[at]) / np.sqrt(d))
        s, c = np.sin(theta), np.cos(theta)
        odd = d % 2
        term, total = (c.copy(), c.copy()) if odd else (np.ones_like(c), np.ones_like(c))
        for k in range(3 if odd else 2, d - 1, 2):
            term = term * ((k - 1) / k * c * c)
            total = total + term
        if odd:
            a = 2 / np.pi * (theta + (s * total if d > 1 else 0.0))
        else:
            a = s * total
        out[at] = np.clip(1 - a, 0.0, 1.0)
    return out


def ols_from_moments(df: DataFrame, keys: list[str], xs: list[str], min_rows: int, full: bool = True) -> DataFrame:
    """Solve each row of moments. Output: keys, n, r2, alpha and b_<x>, with t_ and p_ columns
    if ``full``. Rows under ``min_rows`` observations give NULL results."""
    k = len(xs)
    names = ["alpha", *[f"b_{x}" for x in xs]]
    fields = ["n bigint", "r2 double", *[f"{n} double" for n in names]]
    if full:
        fields += [f"t_{n} double" for n in names] + [f"p_{n} double" for n in names]
    key_types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {key_types[c]}" for c in keys] + fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, mean, c = stacked(pdf, k)
            rows = np.flatnonzero((n >= min_rows) & (n > k))
            width = (3 if full else 1) * (k + 1) + 1
            found = np.full((len(n), width), np.nan)
            coef, se, r2 = solve_stack(n[rows], mean[rows], c[rows])
            parts = [r2[:, None], coef]
            if full:
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(se > 0, coef / se, np.nan)
                parts += [t, t_two_sided(t, (n[rows] - k - 1).astype(int)[:, None])]
            found[rows] = np.concatenate(parts, axis=1)
            out = pdf[keys].copy()
            out["n"] = n.astype(np.int64)
            for name, values in zip([f.split()[0] for f in fields[1:]], found.T, strict=True):
                out[name] = pd.array(np.where(np.isfinite(values), values, 0.0), "Float64")
                out.loc[~np.isfinite(values), name] = pd.NA
            yield out

    return df.select(*keys, *moment_names(k)).mapInPandas(run, schema)
