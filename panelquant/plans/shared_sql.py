"""Shared sub-queries of the reference SQL, by name."""

from ..functions import dist
from ..sources.panels import ITEMS, ITEMS_BY_PRIORITY, MACRO_SERIES


def _bars(col: str, view: str = "part") -> str:
    return f"""
SELECT {col} AS asset, CAST(l_shipdate AS DATE) AS ts,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE)
    / (CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) * 100.0::DOUBLE) AS close,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS DOUBLE)
    / (CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) * 10000.0::DOUBLE) AS adj_close,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS volume
FROM lineitem {'JOIN part ON l_partkey = p_partkey' if col != 'l_partkey' else ''} GROUP BY ALL"""


def _returns(bars: str) -> str:
    return f"""
SELECT * FROM (SELECT asset, ts, close, volume,
  close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r,
  ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS lr FROM {bars}) WHERE r IS NOT NULL"""


def _case(cols: list[str], table: dict, field: int | None) -> str:
    arms = []
    for k, v in table.items():
        k = k if isinstance(k, tuple) else (k,)
        v = v[field] if isinstance(v, tuple) else v
        cond = " AND ".join(f"{c} = '{x}'" for c, x in zip(cols, k))
        arms.append(f"WHEN {cond} THEN " + (str(v).upper() if isinstance(v, bool) else "'" + v + "'"))
    return "CASE " + " ".join(arms) + " END"


def _statements(freq: str) -> str:
    months = 11 if freq == "year" else 2
    k = ["pri", "o_orderstatus"]
    return f"""
SELECT asset, {_case(k, ITEMS, 0)} AS stmt, period_end, {_case(k, ITEMS, 1)} AS item,
  CAST(CASE WHEN {_case(k, ITEMS, 2)} THEN signed ELSE cents END AS DOUBLE) / 100.0::DOUBLE AS value FROM base_{freq}
UNION ALL
SELECT asset, {_case(['pri'], ITEMS_BY_PRIORITY, 0)}, period_end, {_case(['pri'], ITEMS_BY_PRIORITY, 1)},
  CASE WHEN pri = '3' THEN CAST(sum(n) AS DOUBLE) * 1000.0::DOUBLE ELSE CAST(sum(cents) AS DOUBLE) / 100.0::DOUBLE END
FROM base_{freq} GROUP BY asset, period_end, pri"""


def _base(freq: str) -> str:
    months = 11 if freq == "year" else 2
    return f"""
SELECT 'Brand#' || (c_nationkey + 1) AS asset, substr(o_orderpriority, 1, 1) AS pri, o_orderstatus,
  last_day(date_trunc('{freq}', o_orderdate) + INTERVAL {months} MONTH) AS period_end,
  sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents,
  sum(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT)) AS signed,
  count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def _mean(cond: str) -> str:
    return (f"CAST(sum(CASE WHEN {cond} THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE)"
            f" / count(CASE WHEN {cond} THEN 1 END)")


def horner(x: str, coefs) -> str:
    out = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def norm_cdf(z: str) -> str:
    """Normal CDF of a column name or short expression."""
    x, e = f"abs({z})", f"exp(-({z}) * ({z}) / 2)"
    frac = f"({x} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({x} + {k}.0 / {frac})"
    tail = (f"(CASE WHEN {x} > 37 THEN 0.0 WHEN {x} < 7.07106781186547 THEN {e} * {horner(x, dist.CDF_NUM)} / "
            f"{horner(x, dist.CDF_DEN)} ELSE {e} / {frac} / 2.506628274631 END)")
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf(p: str) -> str:
    q = f"(({p}) - 0.5::DOUBLE)"
    r0 = f"(0.180625::DOUBLE - {q} * {q})"
    central = f"{q} * {horner(r0, dist.PPF_CENTRAL_NUM)} / {horner(r0, dist.PPF_CENTRAL_DEN)}"
    r = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1 - ({p}) END))"
    rm, rt = f"({r} - 1.6::DOUBLE)", f"({r} - 5.0::DOUBLE)"
    outer = (f"(CASE WHEN {r} <= 5 THEN {horner(rm, dist.PPF_MIDDLE_NUM)} / {horner(rm, dist.PPF_MIDDLE_DEN)} "
             f"ELSE {horner(rt, dist.PPF_TAIL_NUM)} / {horner(rt, dist.PPF_TAIL_DEN)} END)")
    return (f"(CASE WHEN ({p}) > 0 AND ({p}) < 1 THEN CASE WHEN abs({q}) <= 0.425 THEN {central} "
            f"ELSE sign({q}) * {outer} END END)")


VIEWS: dict[str, str] = {
    "bars_brand": _bars("p_brand"),
    "bars_type": _bars("p_type"),
    "ret_brand": _returns("bars_brand"),
    "ret_type": _returns("bars_type"),
    "bm_brand": "SELECT ts, avg(r) AS bm FROM ret_brand GROUP BY ts",
    "bm_type": "SELECT ts, avg(r) AS bm FROM ret_type GROUP BY ts",
    "base_year": _base("year"),
    "base_quarter": _base("quarter"),
    "stmts": _statements("year"),
    "stmts_q": _statements("quarter"),
    "info": """
SELECT 'Brand#' || (c_nationkey + 1) AS asset,
  CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS market_cap,
  CASE WHEN c_nationkey % 5 <> 0 THEN count(*) * 100.0::DOUBLE END AS shares_outstanding,
  CASE WHEN c_nationkey % 7 <> 0 THEN CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 20000.0::DOUBLE) END AS trailing_pe,
  0.1::DOUBLE + c_nationkey / 20.0::DOUBLE AS beta,
  CASE WHEN c_nationkey % 12 = 0 THEN 'ETF' ELSE 'EQUITY' END AS quote_type
FROM customer GROUP BY c_nationkey""",
    "macro_daily": f"""
SELECT series, ts, CAST(sum(cents) AS DOUBLE) / (count(*) * 1e7) AS value FROM (
  SELECT CAST(o_orderdate AS DATE) AS ts, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    {_case(['o_orderstatus'], MACRO_SERIES['o_orderstatus'], None)} AS series FROM orders
  UNION ALL
  SELECT CAST(o_orderdate AS DATE), CAST(round(o_totalprice * 100) AS BIGINT),
    {_case(['o_orderpriority'], MACRO_SERIES['o_orderpriority'], None)} FROM orders)
WHERE series IS NOT NULL GROUP BY series, ts""",
    "factors": f"""
SELECT month, f / m - 1 AS mkt_rf, o / p - 1 AS smb, u / l - 1 AS hml, 0.002::DOUBLE AS rf, h / x - 1 AS wml FROM (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {_mean('TRUE')} AS m,
    {_mean("o_orderstatus = 'F'")} AS f, {_mean("o_orderstatus = 'O'")} AS o, {_mean("o_orderstatus = 'P'")} AS p,
    {_mean("o_orderpriority = '1-URGENT'")} AS u, {_mean("o_orderpriority = '5-LOW'")} AS l,
    {_mean("o_orderpriority = '2-HIGH'")} AS h, {_mean("o_orderpriority = '4-NOT SPECIFIED'")} AS x
  FROM orders GROUP BY 1)
WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL AND u IS NOT NULL AND l IS NOT NULL AND h IS NOT NULL AND x IS NOT NULL""",
    "chars_wide": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, l_partkey AS asset,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) * 100.0::DOUBLE) AS price,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS volume,
  CASE WHEN max(l_discount) > 0 THEN CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) END AS discount
FROM lineitem GROUP BY ALL""",
    "chars": """
SELECT ts, asset, 'price' AS characteristic, price AS value FROM chars_wide
UNION ALL SELECT ts, asset, 'volume', volume FROM chars_wide
UNION ALL SELECT ts, asset, 'discount', discount FROM chars_wide""",
    "scores_wide": """
SELECT p_brand AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) * 10.0 / count(*) AS M1,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) * 12.5 / count(*) AS M2,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) * 2.0 / count(*) AS M3,
  CASE WHEN count(CASE WHEN l_returnflag = 'A' THEN 1 END) > 0 THEN count(CASE WHEN l_returnflag = 'A' THEN 1 END) * 100.0::DOUBLE / count(*) END AS M4,
  count(CASE WHEN l_linestatus = 'O' THEN 1 END) * 100.0::DOUBLE / count(*) AS M5,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) * 1500.0::DOUBLE) AS M6
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "module_scores": " UNION ALL ".join(
        f"SELECT asset, ts, 'M{i}' AS module, M{i} AS score FROM scores_wide" for i in range(1, 7)),
    "news": """
SELECT 'Brand#' || (doc_id % 25 + 1) AS asset, doc_id, DATE '1998-01-01' + CAST(doc_id % 700 AS INTEGER) AS published_at, text
FROM documents""",
    "vec_ret": """
SELECT vec_id AS ts, i - 1 AS asset, CAST(embedding[i] AS DOUBLE) AS r
FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)""",
    "target_weights": """
SELECT portfolio, asset, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY portfolio) AS w FROM (
  SELECT s_nationkey AS portfolio, 'Brand#' || (s_suppkey % 25 + 1) AS asset,
    sum(greatest(CAST(round(s_acctbal * 100) AS BIGINT), 0)) AS c
  FROM supplier GROUP BY ALL)
QUALIFY sum(c) OVER (PARTITION BY portfolio) > 0""",
    "holdings": """
SELECT c_nationkey AS portfolio, 'Brand#' || (c_custkey % 25 + 1) AS asset,
  CAST(sum(CAST(floor(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0) / 100000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS shares
FROM customer GROUP BY ALL""",
    "candidate_weights": """
SELECT candidate, asset, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY candidate) AS DOUBLE) AS w FROM (
  SELECT l_suppkey AS candidate, p_type AS asset, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "daily_pnl": """
SELECT * FROM (SELECT portfolio, ts, (level / lag(level) OVER (PARTITION BY portfolio ORDER BY ts) - 1) / 10 AS pnl FROM (
  SELECT event_type AS portfolio, CAST(ts AS DATE) AS ts,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS level FROM events GROUP BY 1, 2)) WHERE pnl IS NOT NULL""",
}
