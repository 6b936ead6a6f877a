"""Registry of named queries and of the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.panels import Panels
from .shared_sql import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _finish(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that both engines hand over the same type."""
    return df.select(*[
        F.date_format(F.col(n), "yyyy-MM-dd").alias(n) if t == "date" else F.col(n) for n, t in df.dtypes
    ])


def _replace_calls(sql: str, name: str, fn) -> str:
    """Rewrite NAME(balanced arguments) with fn(argument text)."""
    out, i = "", 0
    pat = re.compile(rf"\b{name}\(")
    while True:
        m = pat.search(sql, i)
        if not m:
            return out + sql[i:]
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[i:m.start()]
        sql, i = fn(sql[m.end():j - 1]) + sql[j:], 0


def expand(sql: str) -> str:
    """Fill in the shared views and the rounding short forms R<k>(x) and D(date)."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if needed:
        ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
        own = re.match(r"(?i)with(\s+recursive)?\b", body)
        if own:
            body = f"{own.group(0)} {ctes},\n" + body[own.end():].lstrip()
        else:
            body = f"WITH {ctes}\n{body}"
    for k in range(1, 11):
        body = _replace_calls(body, f"R{k}", lambda a, k=k: f"(ROUND(CAST({a} AS DOUBLE), {k}) + 0.0)")
    return _replace_calls(body, "D", lambda a: f"strftime({a}, '%Y-%m-%d')")


def query(key: str, oracle: str | None = None):
    """Register fn(panels) -> DataFrame under key, with the SQL it must agree with."""
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: _finish(fn(Panels(spark, sf_dir)))
        if oracle is not None:
            ORACLE[key] = expand(oracle)
        return fn
    return wrap
