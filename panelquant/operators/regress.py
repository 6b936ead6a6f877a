"""Factor regressions (M4) and macro regressions (M6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_time, clip, trailing, with_params
from ..functions.linear import moment_columns, ols_from_moments

FACTORS = ["mkt_rf", "smb", "hml", "wml"]


def factor_columns(df: DataFrame) -> DataFrame:
    """Checks the factor columns; ``mom`` is taken as ``wml``; wml is optional."""
    cols = {c.lower().replace("-", "_"): c for c in df.columns}
    if "wml" not in cols and "mom" in cols:
        df, cols = df.withColumnRenamed(cols["mom"], "wml"), {**cols, "wml": "wml"}
    missing = [c for c in ("mkt_rf", "smb", "hml", "rf") if c not in cols]
    if missing:
        raise ValueError(f"factor data missing columns: {missing}")
    keep = ["mkt_rf", "smb", "hml", "rf"] + (["wml"] if "wml" in cols else [])
    return df.select("month", *[F.col(f"`{cols[c]}`").alias(c) for c in keep])


def monthly_returns(prices: DataFrame, price: str = "close") -> DataFrame:
    """(asset, month, r) from month-end closes; a month without trades repeats the last close."""
    m = prices.groupBy("asset", F.trunc("ts", "month").alias("month")).agg(F.max_by(price, "ts").alias("p"))
    span = m.groupBy("asset").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    w = by_time(ts="month")
    d = span.join(m, ["asset", "month"], "left").withColumn(
        "p", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select("asset", "month", (F.col("p") / F.nullif(F.lag("p").over(w), F.lit(0.0)) - 1).alias("r")).where("r is not null")


def factor_panel(prices: DataFrame, factors: DataFrame) -> DataFrame:
    """(asset, month, r, y = r - rf, factors) on months where both exist."""
    return monthly_returns(prices).join(factor_columns(factors), "month").withColumn("y", F.col("r") - F.col("rf"))


def factor_loadings(panel: DataFrame, xs=None, y: str = "y", min_rows: int = 12, keys=("asset",)) -> DataFrame:
    """OLS with a constant per asset, from one aggregate of moments."""
    xs = xs or FACTORS
    m = panel.groupBy(*keys).agg(*moment_columns(y, xs))
    return ols_from_moments(m, list(keys), xs, min_rows)


def factor_loadings_robust(panel: DataFrame, xs=None, y: str = "y", min_rows: int = 12, tune: float = 1.345,
                           max_iter: int = 50, tol: float = 1e-8) -> DataFrame:
    """Huber regression by iteratively reweighted least squares, one asset's months per group."""
    xs = xs or FACTORS

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[[y, *xs]].dropna()
        rec = {"asset": pdf["asset"].iat[0], "n": len(d)}
        if len(d) >= min_rows:
            a = np.column_stack([np.ones(len(d)), d[xs].to_numpy(float)])
            v = d[y].to_numpy(float)
            coef = np.linalg.lstsq(a, v, rcond=None)[0]
            last = None
            for _ in range(max_iter):
                res = v - a @ coef
                scale = np.median(np.abs(res)) / 0.6744897501960817
                if scale == 0:
                    break
                u = np.abs(res / scale)
                dev = float(np.where(u <= tune, u * u / 2, tune * u - tune * tune / 2).sum())
                if last is not None and abs(dev - last) < tol:
                    break
                last = dev
                sw = np.sqrt(np.minimum(1.0, tune / np.maximum(u, 1e-300)))
                coef = np.linalg.lstsq(a * sw[:, None], v * sw, rcond=None)[0]
            rec.update({"alpha": coef[0], **{f"b_{x}": c for x, c in zip(xs, coef[1:])}})
            rec["r2"] = 1 - np.var(v - a @ coef) / np.var(v) if np.var(v) > 0 else None
        return pd.DataFrame([rec], columns=["asset", "n", "r2", "alpha", *[f"b_{x}" for x in xs]])

    schema = "asset string, n bigint, r2 double, alpha double, " + ", ".join(f"b_{x} double" for x in xs)
    return panel.select("asset", y, *xs).groupBy("asset").applyInPandas(fit, schema)


def rolling_factor_loadings(panel: DataFrame, xs=None, y: str = "y", window: int = 36, ts: str = "month") -> DataFrame:
    """OLS on each trailing window of complete rows."""
    xs = xs or FACTORS
    d = panel.dropna(subset=[y, *xs])
    w = trailing(window, ts=ts)
    m = d.select("asset", ts, *moment_columns(y, xs, over=w)).where(F.col("_n") == window)
    return ols_from_moments(m, ["asset", ts], xs, window, full=False)


def residuals(panel: DataFrame, loadings: DataFrame, xs=None, y: str = "y", with_alpha: bool = True) -> DataFrame:
    xs = xs or FACTORS
    cols = ["asset", "alpha", *[f"b_{x}" for x in xs]]
    d = panel.join(loadings.select(*cols), "asset")
    fit = sum((F.col(f"b_{x}") * F.col(x) for x in xs), F.col("alpha") if with_alpha else F.lit(0.0))
    return d.withColumn("resid", F.col(y) - fit)


def residual_information_ratio(resid: DataFrame, value: str = "resid", min_rows: int = 12) -> DataFrame:
    """Annualised mean over deviation of monthly residuals, with a label at 1, 0.5 and 0."""
    g = resid.groupBy("asset").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    ok = (F.col("n") >= min_rows) & (F.col("s") > 0)
    a, v = F.col("m") * 12, F.col("s") * F.sqrt(F.lit(12.0))
    g = g.select("asset", F.when(ok, a / F.nullif(v, F.lit(0.0))).alias("ir"), F.when(ok, a).alias("annualised_alpha"),
                 F.when(ok, v).alias("idiosyncratic_vol"))
    return g.withColumn("interpretation", F.when(F.col("ir") > 1, "Excellent").when(F.col("ir") > 0.5, "Good").when(
        F.col("ir") > 0, "Average").when(F.col("ir").isNotNull(), "Negative"))


def variance_decomposition(panel: DataFrame, loadings: DataFrame, xs=None, ret: str = "r") -> DataFrame:
    """b' cov(f) b against the total variance."""
    xs = xs or FACTORS
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    g = panel.groupBy("asset").agg(F.var_samp(ret).alias("total_var"),
                                   *[F.covar_samp(xs[i], xs[j]).alias(f"_c{i}{j}") for i, j in pairs])
    d = g.join(loadings.select("asset", *[f"b_{x}" for x in xs]), "asset")
    s = sum((F.col(f"_c{i}{j}") * F.col(f"b_{xs[i]}") * F.col(f"b_{xs[j]}") * (1.0 if i == j else 2.0) for i, j in pairs), F.lit(0.0))
    d = d.select("asset", "total_var", s.alias("systematic_var"))
    return d.withColumn("idiosyncratic_var", F.col("total_var") - F.col("systematic_var")).withColumn(
        "r_squared", F.when(F.col("total_var") > 0, F.col("systematic_var") / F.col("total_var")).otherwise(0.0))


def score_factors(panel: DataFrame) -> DataFrame:
    """M4: 50 + alpha t-statistic (+-25) + R2 around 0.4 (+-10) + residual information ratio (+-15)."""
    load = factor_loadings(panel)
    ir = residual_information_ratio(residuals(panel, load)).select("asset", "ir")
    d = load.join(ir, "asset", "left")
    score = (50.0 + F.coalesce(clip("t_alpha", -3, 3), F.lit(0.0)) / 3.0 * 25.0
             + clip((F.col("r2") - 0.40) / 0.30 * 10.0, -10, 10)
             + F.coalesce(clip("ir", -2, 2), F.lit(0.0)) / 2.0 * 15.0)
    return d.select("asset", F.coalesce(clip(score, 0, 100), F.lit(50.0)).alias("score"), "t_alpha", "r2", "n")


# -- macro ------------------------------------------------------------------------------------
# Series id -> name used by the features.
SERIES_NAMES = {
    "T10Y2Y": "term_spread",
    "BAMLH0A0HYM2": "credit_spread",
    "CPIAUCSL": "cpi",
    "CPILFESL": "cpi",
    "UNRATE": "unemployment",
    "FEDFUNDS": "fed_funds",
    "GS10": "treasury_10y",
    "GS2": "treasury_2y",
    "Fed Funds Rate": "fed_funds",
    "Term Spread": "term_spread",
    "HY Spread": "credit_spread",
}
MACRO_COLUMNS = ["term_spread", "credit_spread", "cpi", "unemployment", "fed_funds", "treasury_10y", "treasury_2y"]
MACRO_FEATURES = ["delta_term_spread", "delta_credit_spread", "delta_fed_funds", "yoy_cpi", "yoy_unemployment"]
# Shock per feature of the two built-in scenarios.
MACRO_SHOCKS = {
    "2008_Crisis": {"delta_term_spread": -0.02, "delta_credit_spread": 0.04, "yoy_cpi": -0.01, "yoy_unemployment": 0.05},
    "2020_Covid": {"delta_term_spread": 0.01, "delta_credit_spread": 0.03, "yoy_cpi": -0.02, "yoy_unemployment": 0.10},
}


def macro_wide(monthly: DataFrame) -> DataFrame:
    """(series, month_end, value) to one row per month with canonical columns; the term spread is
    derived from the 10- and 2-year rates where it is not given."""
    names = F.create_map(*[F.lit(x) for kv in SERIES_NAMES.items() for x in kv])
    d = monthly.withColumn("name", F.coalesce(F.try_element_at(names, "series"), F.col("series")))
    w = d.groupBy("month_end").pivot("name", MACRO_COLUMNS).agg(F.first("value", ignorenulls=True))
    return w.withColumn("term_spread", F.coalesce("term_spread", F.col("treasury_10y") - F.col("treasury_2y")))


def macro_features(wide: DataFrame, lag_months: int = 1) -> DataFrame:
    """First differences of spreads and rates, 12-row changes of cpi and unemployment, lagged."""
    w = Window.partitionBy("cal").orderBy("month_end")  # one row per month
    d = wide.withColumn("cal", F.lit("month"))
    cols = {f"delta_{c}": F.col(c) - F.lag(c).over(w) for c in ("term_spread", "credit_spread", "fed_funds")}
    cols |= {f"yoy_{c}": F.col(c) / F.nullif(F.lag(c, 12).over(w), F.lit(0.0)) - 1 for c in ("cpi", "unemployment")}
    d = d.withColumns(cols)
    return d.select("month_end", *[F.lag(c, lag_months).over(w).alias(c) for c in MACRO_FEATURES]).dropna()


def macro_regime(wide: DataFrame, spread: str = "term_spread") -> DataFrame:
    return wide.select("month_end", spread, F.when(F.col(spread) < 0, "contraction").otherwise("expansion").alias("regime"))


def macro_panel(prices: DataFrame, features: DataFrame) -> DataFrame:
    r = monthly_returns(prices).withColumn("month_end", F.last_day("month"))
    return r.join(features, "month_end").select("asset", "month_end", F.col("r").alias("y"), *MACRO_FEATURES)


def macro_betas(panel: DataFrame) -> DataFrame:
    return factor_loadings(panel, MACRO_FEATURES, min_rows=10)


def macro_betas_rolling(panel: DataFrame, window: int = 36) -> DataFrame:
    return rolling_factor_loadings(panel, MACRO_FEATURES, window=window, ts="month_end")


def macro_score(features: DataFrame, betas: DataFrame) -> DataFrame:
    """Constant plus beta times the latest features; sign as tailwind."""
    last = features.agg(F.max_by(F.struct(*MACRO_FEATURES), "month_end").alias("f"))
    d = betas.withColumn("f", last.scalar())
    pred = sum((F.coalesce(F.col(f"b_{c}") * F.col(f"f.{c}"), F.lit(0.0)) for c in MACRO_FEATURES), F.coalesce("alpha", F.lit(0.0)))
    return d.select("asset", pred.alias("predicted_macro_return")).withColumn(
        "macro_tailwind", F.when(F.col("predicted_macro_return") > 0, 1).otherwise(-1).cast("bigint"))


def macro_stress(betas: DataFrame, scenarios: dict | None = None) -> DataFrame:
    """Constant plus beta times shock per scenario."""
    scenarios = scenarios or MACRO_SHOCKS
    rows = [(n, *[float(s.get(c, 0.0)) for c in MACRO_FEATURES]) for n, s in scenarios.items()]
    d = with_params(betas, rows, ["scenario", *[f"s_{c}" for c in MACRO_FEATURES]])
    hit = sum((F.coalesce(F.col(f"b_{c}") * F.col(f"s_{c}"), F.lit(0.0)) for c in MACRO_FEATURES), F.coalesce("alpha", F.lit(0.0)))
    return d.select("asset", "scenario", hit.alias("impact"))


def score_macro(prices: DataFrame, wide: DataFrame) -> DataFrame:
    """M6: 80 / 50 / 20 at a predicted monthly return of +-2 %."""
    feats = macro_features(wide)
    s = macro_score(feats, macro_betas(macro_panel(prices, feats)))
    now = wide.agg(F.max_by(F.when(F.col("term_spread") < 0, "contraction").otherwise("expansion"), "month_end").alias("g"))
    p = F.col("predicted_macro_return")
    return s.select("asset", F.when(p > 0.02, 80.0).when(p < -0.02, 20.0).otherwise(50.0).alias("score"),
                    now.scalar().alias("regime"), "predicted_macro_return")
