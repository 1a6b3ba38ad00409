"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidelog.plans import pipeline, reference

QUERIES = {**reference.QUERIES, **pipeline.QUERIES}
SQL = {**reference.SQL, **pipeline.SQL}
