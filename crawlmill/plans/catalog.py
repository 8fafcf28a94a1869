"""All registered queries: importing the modules fills the registry."""

from . import q_pages, q_prices, q_quality, q_snapshots, q_tables, q_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
