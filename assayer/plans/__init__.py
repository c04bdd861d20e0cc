"""Queries over the driver's tables, each with equivalent SQL where SQL can say it."""

from . import analysis, gates, guards, replies, selection, streams, texts
from .base import OPS, QUERIES, SQL

__all__ = ["OPS", "analysis", "gates", "guards", "oracle_sql", "queries", "replies", "selection", "streams", "texts"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
