"""Text, pairs, score integration, ablation, models and sensitivity."""

from pyspark.sql import functions as F

from ..functions.columns import rounded, trailing, when_full
from ..functions.mixing import MOD, sql_mix, sql_rounds
from ..operators import pairs as pr
from ..operators import scores as sc
from ..operators import text as tx
from .registry import query
from .shared_sql import VIEWS

# The texts of the given tables hold none of the default words, so frequent ones stand in.
POS, NEG = ["with", "for", "und", "les", "que", "he"], ["was", "by", "des", "die", "en", "la"]
EVENTS = {"earnings_beat": ["of thes?", "in the"], "earnings_miss": ["der die", "das? ist"], "guidance_cut": ["de la", "de les?"],
          "management_change": ["que el", "los? que"], "regulatory_probe": ["is that"], "capital_return": ["und der?"]}
_words = {n: "(" + ", ".join(f"'{w}'" for w in ws) + ")" for n, ws in (("p", POS), ("n", NEG))}
VIEWS["sentiment_v"] = f"""
SELECT asset, doc_id, published_at, CASE WHEN n <= 0 THEN 0.33 WHEN p + q = 0 THEN 0.15 ELSE p / (p + q + 2.0::DOUBLE) END::DOUBLE AS prob_pos,
  CASE WHEN n <= 0 THEN 0.34 WHEN p + q = 0 THEN 0.70 ELSE greatest(0, 1 - p / (p + q + 2.0::DOUBLE) - q / (p + q + 2.0::DOUBLE)) END::DOUBLE AS prob_neu,
  CASE WHEN n <= 0 THEN 0.33 WHEN p + q = 0 THEN 0.15 ELSE q / (p + q + 2.0::DOUBLE) END::DOUBLE AS prob_neg FROM (
  SELECT asset, doc_id, published_at, len(t) AS n, len(list_filter(t, lambda x: x IN {_words['p']})) AS p, len(list_filter(t, lambda x: x IN {_words['n']})) AS q FROM (
    SELECT asset, doc_id, published_at, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS t FROM news))"""


def _scored(p):
    return tx.text_sentiment(p.news(), positive=POS, negative=NEG).drop("text")


@query("text_sentiment", "SELECT doc_id, R8(prob_pos) AS prob_pos, R8(prob_neu) AS prob_neu, R8(prob_neg) AS prob_neg, R8(prob_pos - prob_neg) AS sentiment_score FROM sentiment_v")
def _(p):
    return rounded(_scored(p).select("doc_id", "prob_pos", "prob_neu", "prob_neg", "sentiment_score"), 8)


@query("text_events", " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS event_type FROM news WHERE " + " OR ".join(f"regexp_matches(lower(text), '{x}')" for x in ps) for n, ps in EVENTS.items()))
def _(p):
    return tx.text_events(p.news(), patterns=EVENTS).select("doc_id", F.explode("events").alias("event_type"))


VIEWS["daily_sent"] = """
SELECT *, e - coalesce(lag(e, 20) OVER (PARTITION BY asset ORDER BY n), 0) AS mom FROM (
  SELECT a.asset, a.ts, a.n, any_value(a.x) AS x, sum(b.x * pow(0.85::DOUBLE, a.n - b.n)) / ((1 - pow(0.85::DOUBLE, a.n + 1)) / (1 - 0.85::DOUBLE)) AS e FROM sent_days a
  JOIN sent_days b ON a.asset = b.asset AND b.n BETWEEN a.n - 300 AND a.n GROUP BY a.asset, a.ts, a.n)"""
VIEWS["sent_days"] = """
SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS n, greatest(-1, least(1, coalesce(s, 0))) AS x FROM (SELECT asset, ts FROM bars_brand)
LEFT JOIN (SELECT d.asset, b.ts, sum(prob_pos - prob_neg) AS s FROM sentiment_v d ASOF JOIN bars_brand b ON d.asset = b.asset AND d.published_at >= b.ts GROUP BY 1, 2) USING (asset, ts)"""


def _daily(p):
    return tx.daily_sentiment(_scored(p), p.closes())


@query("daily_sentiment", "SELECT asset, D(ts) AS ts, R9(x) AS daily_sentiment, R9(e + 1e-12::DOUBLE) AS ewma_sentiment, R9(mom + 1e-12::DOUBLE) AS sentiment_momentum FROM daily_sent")
def _(p):
    # powers of 0.85 are finite decimals: an offset below the last digit keeps their ties from falling either way
    d = _daily(p).withColumns({c: F.col(c) + 1e-12 for c in ("ewma_sentiment", "sentiment_momentum")})
    return rounded(d.select("asset", "ts", "daily_sentiment", "ewma_sentiment", "sentiment_momentum"), 9)


@query("score_sentiment", """
SELECT asset, R6(greatest(0, least(100, 50 + 35 * last(e ORDER BY n) + 15 * last(mom ORDER BY n)))) AS score, CASE WHEN any_value(c) > 0 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence, coalesce(any_value(c), 0) AS news_items
FROM daily_sent LEFT JOIN (SELECT asset, count(*) AS c FROM news GROUP BY asset) USING (asset) GROUP BY asset""")
def _(p):
    return rounded(tx.score_sentiment(_daily(p), p.news()))


# -- pairs --------------------------------------------------------------------------------------------
@query("ou_half_life", """
WITH s AS (SELECT asset, ts, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS v FROM bars_brand WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
l AS (SELECT asset, v, lag(v) OVER (PARTITION BY asset ORDER BY ts) AS p FROM s WHERE v IS NOT NULL),
g AS (SELECT asset, regr_slope(v, p) AS b, regr_intercept(v, p) AS a, var_pop(v) FILTER (p IS NOT NULL) - regr_slope(v, p) * covar_pop(v, p) AS rv, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY asset)
SELECT asset, R6(CASE WHEN b > 0 AND b < 1 THEN -ln(b) * 252 ELSE 0 END) AS theta, R6(CASE WHEN b > 0 AND b < 1 THEN a / (1 - b) ELSE m END) AS mu,
  R4(CASE WHEN b > 0 AND b < 1 THEN sqrt(rv) ELSE s END * sqrt(252)) AS sigma, R6(CASE WHEN b > 0 AND b < 1 THEN ln(2) / -ln(b) ELSE 999 END) AS half_life_days FROM g""")
def _(p):
    w = trailing(20)
    s = p.closes().select("asset", "ts", when_full(F.avg("close").over(w), "close", 20, w).alias("value")).where("value is not null")
    return rounded(pr.ou_half_life(s), 6, sigma=4)


@query("cointegration")
def _(p):
    c = p.closes()
    idx = c.groupBy("ts").agg(F.avg("close").alias("b"))
    return rounded(pr.cointegration(c.join(idx, "ts").select(F.col("asset").alias("pair"), "ts", F.col("close").alias("a"), "b")))


@query("scan_pairs")
def _(p):
    return rounded(pr.scan_pairs(p.closes())).orderBy("p_value", "asset_a", "asset_b")


# -- integration --------------------------------------------------------------------------------------
E = "asset, D(ts) AS ts"
VIEWS["clipped"] = "SELECT asset, ts, module, least(greatest(score, 0), 100) AS score FROM module_scores WHERE score IS NOT NULL"
VIEWS["mweights"] = "SELECT module, 1 / (stddev_samp(score) + 1e-8) / sum(1 / (stddev_samp(score) + 1e-8)) OVER () AS weight FROM clipped GROUP BY module"
VIEWS["compos"] = "SELECT asset, ts, count(*) AS n_modules, sum(weight * score) / sum(weight) AS composite FROM clipped JOIN mweights USING (module) GROUP BY asset, ts"
VIEWS["compos_eq"] = "SELECT asset, ts, count(*) AS n_modules, avg(score) AS composite, max(CASE WHEN module = 'M5' THEN score END) AS risk FROM clipped GROUP BY asset, ts"


@query("clip_scores", f"SELECT {E}, module, R6(score) AS score FROM clipped")
def _(p):
    return rounded(sc.clip_scores(p.module_scores()))


@query("module_correlation", """
WITH p AS (SELECT a.module AS module_a, b.module AS module_b, a.score AS x, b.score AS y FROM clipped a JOIN clipped b ON a.asset = b.asset AND a.ts = b.ts AND a.module < b.module),
r AS (SELECT module_a, module_b, rank() OVER (PARTITION BY module_a, module_b ORDER BY x) + (count(*) OVER (PARTITION BY module_a, module_b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY module_a, module_b ORDER BY y) + (count(*) OVER (PARTITION BY module_a, module_b, y) - 1) / 2.0 AS ry FROM p)
SELECT module_a, module_b, count(*) AS n, R6(CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END) AS correlation, abs(CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END) > 0.7 AS high FROM r GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(p):
    return rounded(sc.module_correlation(sc.clip_scores(p.module_scores())))


@query("module_weights", "SELECT 'vol_adjusted' AS scheme, module, R8(weight) AS weight FROM mweights UNION ALL SELECT 'equal', module, R8(1.0 / count(*) OVER ()) FROM (SELECT DISTINCT module FROM clipped)")
def _(p):
    s = sc.clip_scores(p.module_scores())
    out = [sc.module_weights(s, n).withColumn("scheme", F.lit(n)) for n in ("vol_adjusted", "equal")]
    return rounded(out[0].unionByName(out[1]), 8)


@query("composite_score", f"SELECT {E}, n_modules, R6(composite) AS composite FROM compos")
def _(p):
    s = sc.clip_scores(p.module_scores())
    return rounded(sc.composite_score(s, sc.module_weights(s, "vol_adjusted")))


@query("risk_adjusted_score", f"SELECT {E}, R6(composite) AS composite, R6(risk) AS risk, R6(0.3 * (100 - risk) / 100) AS penalty, R6(composite * (1 - 0.3 * (100 - risk) / 100)) AS adjusted FROM compos_eq")
def _(p):
    w = sc.wide_scores(sc.clip_scores(p.module_scores()))
    d = w.select("asset", "ts", sc.mean_aggregator({m: F.col(m) for m in sc.MODULES}).alias("composite"), F.col("M5").alias("risk"))
    return rounded(sc.risk_adjusted_score(d))


def _ci_sql(scheme: str, risk: str) -> str:
    """Unrounded (asset, ts, lo, hi)."""
    mods = sc.MODULES
    weight = {m: f"max(CASE WHEN module = '{m}' THEN weight END)" if scheme == "vol_adjusted" else "1.0::DOUBLE" for m in mods}
    src = "SELECT s.*, r FROM (SELECT asset, ts, CAST(regexp_extract(asset, '[0-9]+') AS BIGINT) AS k1, date_diff('day', DATE '1970-01-01', ts) AS k2, " + ", ".join(
        f"CASE WHEN {m} IS NOT NULL THEN least(greatest({m}, 0), 100) END AS {m}" for m in mods) + " FROM scores_wide) s, (SELECT unnest(generate_series(1, 1000)) AS r)"
    for i in range(2 * len(mods)):
        src = sql_rounds(src, sql_mix("k1", "k2", f"r * 16 + {i}"), f"x{i}")
    src = "SELECT *, " + ", ".join(f"(x{i} + 0.5::DOUBLE) / {MOD}.0::DOUBLE AS u{i}" for i in range(2 * len(mods))) + f" FROM ({src})"
    noisy = [f"CASE WHEN {m} IS NOT NULL THEN w_{m} * least(greatest({m} + 10.0 * sqrt(-2 * ln(u{2 * i})) * cos(2 * pi() * u{2 * i + 1}), 0), 100) ELSE 0 END" for i, m in enumerate(mods)]
    cnt = " + ".join(f"CASE WHEN {m} IS NOT NULL THEN w_{m} ELSE 0 END" for m in mods)
    return f"""SELECT asset, ts, quantile_cont(a, 0.05) AS lo, quantile_cont(a, 0.95) AS hi FROM (
SELECT asset, ts, ({' + '.join(noisy)}) / ({cnt}) * (1 - 0.3 * (100 - {risk}) / 100) AS a FROM ({src}), (SELECT {", ".join(f"{weight[m]} AS w_{m}" for m in mods)} FROM mweights)) GROUP BY asset, ts"""


def _key() -> dict:
    return {"k1": F.regexp_extract("asset", "[0-9]+", 0).cast("bigint"), "k2": F.unix_date("ts").cast("bigint")}


@query("composite_ci", f"SELECT asset, D(ts) AS ts, R6(lo) AS ci_lower, R6(hi) AS ci_upper FROM ({_ci_sql('vol_adjusted', 'M5')})")
def _(p):
    s = sc.clip_scores(p.module_scores())
    return rounded(sc.composite_ci(sc.wide_scores(s).withColumns(_key()), ["asset", "ts"], sc.MODULES, "M5", ["k1", "k2"], weights=sc.module_weights(s, "vol_adjusted")))


@query("integrate", f"""
WITH ci AS ({_ci_sql("equal", "coalesce(M5, 50)").replace("FROM mweights", "")}),
mp AS (SELECT a.module AS module_a, b.module AS module_b, a.score AS x, b.score AS y FROM clipped a JOIN clipped b ON a.asset = b.asset AND a.ts = b.ts AND a.module < b.module),
mr AS (SELECT module_a, module_b, rank() OVER (PARTITION BY module_a, module_b ORDER BY x) + (count(*) OVER (PARTITION BY module_a, module_b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY module_a, module_b ORDER BY y) + (count(*) OVER (PARTITION BY module_a, module_b, y) - 1) / 2.0 AS ry FROM mp),
hi AS (SELECT coalesce(string_agg(pair, ', ' ORDER BY pair), '') AS correlated FROM (SELECT module_a || '-' || module_b AS pair FROM mr GROUP BY module_a, module_b HAVING count(*) >= 5 AND var_pop(rx) > 0 AND var_pop(ry) > 0 AND abs(CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END) > 0.7))
SELECT {E}, n_modules, R6(composite) AS composite, R6(coalesce(risk, 50)) AS risk, R6(0.3 * (100 - coalesce(risk, 50)) / 100) AS penalty, R6(composite * (1 - 0.3 * (100 - coalesce(risk, 50)) / 100) + 1e-9::DOUBLE) AS adjusted,
  R6(lo) AS ci_lower, R6(hi) AS ci_upper, correlated, CASE WHEN n_modules < 3 THEN 'Only ' || n_modules || ' modules produced valid scores' ELSE '' END AS warning
FROM compos_eq JOIN ci USING (asset, ts), hi""")
def _(p):
    # scores are multiples of a twelfth: an offset below the last digit keeps their ties from falling either way
    return rounded(sc.integrate(p.module_scores(), key=_key()).withColumn("adjusted", F.col("adjusted") + 1e-9))


@query("walkforward_score", f"SELECT {E}, greatest(0::DOUBLE, least(100::DOUBLE, (coalesce(M1, 50) + coalesce(M2, 50) + coalesce(M3, 50) + coalesce(M4, 50)) / 4 * (1 - 0.25::DOUBLE * (100 - coalesce(M5, 50)) / 100))) AS score FROM scores_wide")
def _(p):
    return sc.walkforward_score(sc.wide_scores(p.module_scores())).select("asset", "ts", "score")


def _mean_sql(mods) -> str:
    return "((" + " + ".join(f"coalesce({m}, 0)" for m in mods) + ") / nullif(" + " + ".join(f"({m} IS NOT NULL)::INT" for m in mods) + ", 0))"


VIEWS["ablation_v"] = " UNION ALL ".join(
    f"SELECT '{m}' AS module, avg(abs({_mean_sql(sc.MODULES)} - {_mean_sql([x for x in sc.MODULES if x != m])})) AS score_change, avg(abs({_mean_sql(sc.MODULES)})) AS base FROM scores_wide" for m in sc.MODULES)


@query("module_ablation", "SELECT module, R6(score_change) AS score_change, R6(score_change / base) AS pct_change FROM ablation_v")
def _(p):
    return rounded(sc.module_ablation(sc.wide_scores(p.module_scores())))


_PENALTY = "(1 - 0.3 * (100 - coalesce(M5, 50)) / 100)"
VIEWS["ablation_r"] = " UNION ALL ".join(
    f"SELECT '{m}' AS module, avg(abs({_mean_sql(sc.MODULES)} - {_mean_sql([x for x in sc.MODULES if x != m])}) * {_PENALTY}) AS score_change, avg(abs({_mean_sql(sc.MODULES)}) * {_PENALTY}) AS base FROM scores_wide" for m in sc.MODULES)


@query("module_ablation_risk", "SELECT module, R6(score_change) AS score_change, R6(score_change / base) AS pct_change FROM ablation_r")
def _(p):
    return rounded(sc.module_ablation(sc.wide_scores(p.module_scores()), aggregator=sc.risk_aggregator, risk="M5"))


@query("rank_modules", """
SELECT module, R6(score_change) AS score_impact, rank() OVER (ORDER BY score_change DESC) AS rank, CASE WHEN score_change > 0.5 THEN 'Critical component, highly unique information.'
  WHEN score_change > 0.1 THEN 'Valuable component, adds some unique information.' ELSE 'Redundant component, provides little unique information.' END AS interpretation FROM ablation_v""")
def _(p):
    return rounded(sc.rank_modules(sc.module_ablation(sc.wide_scores(p.module_scores()))).select("module", "score_impact", "rank", "interpretation"))


@query("model_a", """
SELECT x.asset, R6(0.5 * coalesce(p / q - 1, 0) + 0.5 * coalesce(-(trailing_pe - 15) / 5.0, 0)) AS score FROM (
  SELECT asset, last(close ORDER BY ts) AS p, last(q ORDER BY ts) AS q FROM (SELECT asset, ts, close, lag(close, 251) OVER (PARTITION BY asset ORDER BY ts) AS q FROM bars_brand) GROUP BY asset) x LEFT JOIN info USING (asset)""")
def _(p):
    return rounded(sc.model_a(p.closes(), p.info()))


@query("model_b", f"SELECT {E}, R6({_mean_sql(['M1', 'M2', 'M3', 'M4'])}) AS score FROM scores_wide")
def _(p):
    return rounded(sc.model_b(p.module_scores()))


@query("model_c", f"SELECT {E}, R6({_mean_sql(['M1', 'M2', 'M3', 'M4'])} - 0.5 * coalesce(M5, 0)) AS score FROM scores_wide")
def _(p):
    return rounded(sc.model_c(p.module_scores()))


@query("model_d", f"SELECT {E}, R6({_mean_sql(['M1', 'M2', 'M3', 'M4'])} - 0.5 * coalesce(M5, 0) + coalesce(M6, 0)) AS score FROM scores_wide")
def _(p):
    return rounded(sc.model_d(p.module_scores()))


@query("compare_models", """
WITH d AS (SELECT asset, ts, r, bm, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY ts)) AS w FROM ret_type JOIN bm_type USING (ts)),
e AS (SELECT *, w / max(w) OVER (PARTITION BY asset ORDER BY ts) - 1 AS dd FROM d)
SELECT asset AS model, R6(avg(r) * 252 / (stddev_samp(r) * sqrt(252))) AS sharpe_ratio, R6(avg(r - bm) * 252 / (stddev_samp(r - bm) * sqrt(252))) AS information_ratio,
  R6(min(dd)) AS max_drawdown, R6(avg(r) * 252) AS annual_return, R6(stddev_samp(r) * sqrt(252)) AS annual_volatility FROM e GROUP BY asset""")
def _(p):
    return rounded(sc.compare_models(p.returns("p_type").select(F.col("asset").alias("model"), "ts", "r"), p.benchmark("p_type")))


GRID = {"risk_lambda": [0.1, 0.2, 0.3, 0.5, 0.8], "m6_weight": [0.0, 0.5, 1.0, 2.0]}
_base4 = _mean_sql(["M1", "M2", "M3", "M4"])


def _score(name, value):
    base = sc.mean_aggregator({m: F.col(m) for m in ("M1", "M2", "M3", "M4")})
    lam = value if name == "risk_lambda" else 0.3
    w6 = value if name == "m6_weight" else 0.25
    return F.avg((base + w6 * F.coalesce("M6", F.lit(0.0))) * (1 - lam * (100 - F.col("M5")) / 100))


def _score_sql(name, value):
    lam = value if name == "risk_lambda" else 0.3
    w6 = value if name == "m6_weight" else 0.25
    return f"avg(({_base4} + {w6} * coalesce(M6, 0)) * (1 - {lam} * (100 - M5) / 100))"


def _sweep_sql(grid) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS param, {v}::DOUBLE AS param_value, {_score_sql(n, v)} AS s, {_score_sql('baseline', None)} AS b FROM scores_wide" for n, vs in grid.items() for v in vs)
    return f"SELECT param, param_value, s, (s - b) / b AS pct, coalesce((s - lag(s) OVER w) / (param_value - lag(param_value) OVER w), 0) AS sens FROM ({rows}) WINDOW w AS (PARTITION BY param ORDER BY param_value)"


VIEWS["sweep_all"] = _sweep_sql(GRID)
SHOW = "SELECT param, param_value, R6(s) AS output_score, R6(pct) AS pct_change_from_baseline, R6(sens) AS sensitivity FROM "


@query("parameter_sweep", SHOW + f"({_sweep_sql({'risk_lambda': GRID['risk_lambda']})})")
def _(p):
    return rounded(sc.parameter_sweep(sc.wide_scores(p.module_scores()), "risk_lambda", GRID["risk_lambda"], _score))


@query("full_sensitivity", SHOW + "sweep_all")
def _(p):
    return rounded(sc.full_sensitivity(sc.wide_scores(p.module_scores()), GRID, _score))


@query("rank_parameters", "SELECT param, R6(stddev_samp(s) / avg(abs(s))) AS sensitivity_score, rank() OVER (ORDER BY stddev_samp(s) / avg(abs(s)) DESC) AS rank FROM sweep_all GROUP BY param")
def _(p):
    return rounded(sc.rank_parameters(sc.full_sensitivity(sc.wide_scores(p.module_scores()), GRID, _score)))
