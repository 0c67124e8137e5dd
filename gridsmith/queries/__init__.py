"""All registered queries; importing this package fills the registry."""

from . import charts, cleaning, models, nan, profiles, streams, tables  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
