"""Registered queries."""

from __future__ import annotations

from tidewatch.plans import assessments, coordination, core, details, feeds, lifecycle, quality, records, texts

MODULES = (core, quality, records, texts, lifecycle, coordination, assessments, feeds, details)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
