"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

from . import documents, meets, rankings, records, streams

QUERIES = {**rankings.QUERIES, **records.QUERIES, **meets.QUERIES, **streams.QUERIES, **documents.QUERIES}
ORACLES = {**rankings.ORACLES, **records.ORACLES, **meets.ORACLES, **streams.ORACLES, **documents.ORACLES}
