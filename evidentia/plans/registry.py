"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.plans import code_queries, context_queries, edge_queries, edit_queries, event_queries, finding_queries, gate_queries, more_queries, phase_queries, resolve_queries, script_queries, source_queries, summary_queries

_MODULES = (finding_queries, summary_queries, code_queries, context_queries, edge_queries, edit_queries, event_queries, gate_queries, phase_queries, source_queries, resolve_queries, script_queries, more_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_queries.dimension_scores(spark, sf_dir)
