"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

from quercus.plans import clusters, records, similarity, sources

SQL = {**similarity.SQL, **records.SQL, **clusters.SQL, **sources.SQL}
