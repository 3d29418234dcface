"""All registered queries: ``name -> (callable(spark, sf_dir), oracle SQL or None)``."""

from __future__ import annotations

from kgflow.plans import file_queries, forms_queries, kg_more_queries, kg_queries, link_queries, qgraph_queries

CATALOG: dict = {}
for _mod in (kg_queries, kg_more_queries, forms_queries, file_queries, link_queries, qgraph_queries):
    CATALOG.update(_mod.QUERIES)
