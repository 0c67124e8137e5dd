"""The queries opN_<name> and ``pipeline``, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import classifiers, duplicates, filters, hygiene, mining, pipeline, tokens
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "classifiers", "duplicates", "filters", "hygiene", "mining", "pipeline", "tokens"]
