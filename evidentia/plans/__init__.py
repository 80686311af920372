"""Registered queries: each operator applied to the driver's tables, with the same result stated in SQL."""

from . import admission, channels, evaluation, flagship, governance, graphs, integrity, joins, ledger, ranking, sources, text
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "admission", "channels", "evaluation", "flagship", "governance", "graphs", "integrity", "joins", "ledger", "ranking", "sources", "text"]
