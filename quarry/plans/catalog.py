"""Imports every plan module, so that its queries are registered."""

from __future__ import annotations

from quarry.plans import commits, context, evidence, files, grounding, records, runs, traces, vault
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "commits", "context", "evidence", "files", "grounding", "records", "runs", "traces", "vault"]
