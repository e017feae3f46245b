"""All queries over the tables, and their SQL."""

from __future__ import annotations

from . import details, further, ledgers, named, readers, recount, revisions, spans, streams, words

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (words, named, readers, spans, revisions, ledgers, details, recount, further, streams):
    QUERIES |= _module.PLANS.queries
    SQL |= _module.PLANS.sql
