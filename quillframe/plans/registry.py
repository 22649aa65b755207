"""The queries over the driver's tables and their SQL, gathered from the plan modules."""

from __future__ import annotations

from quillframe.plans import documents, events, fields, narratives, notices, records, resolution, results, scoring, storage, vectors

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (scoring, resolution, vectors, documents, notices, narratives, events, results, fields, records, storage):
    QUERIES |= _module.book.queries
    ORACLES |= _module.book.oracles
