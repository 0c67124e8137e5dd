"""The whole pipeline as one query."""

from __future__ import annotations

import corpus_pipeline

from .registry import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
