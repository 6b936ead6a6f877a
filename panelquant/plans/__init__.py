"""Named queries over the given tables and the SQL they are checked against."""

from . import ingest, panel, assets, regressions, portfolio, signals, backtests, research, universe  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
