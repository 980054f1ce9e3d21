"""All named queries outside the llm subpackage."""

from __future__ import annotations

from quercus.plans import clusters, packed, records, similarity, sources

QUERIES = {**packed.QUERIES, **similarity.QUERIES, **records.QUERIES, **clusters.QUERIES, **sources.QUERIES}
