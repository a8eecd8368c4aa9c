"""Queries of the text operators and their DuckDB equivalents."""

from __future__ import annotations

from tallyloom.llm import languages, lines, mixing, packing, quality, sampling, sentences, spam, subjects, toxicity

_MODULES = (subjects, languages, sampling, toxicity, sentences, lines, quality, packing, mixing, spam)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
