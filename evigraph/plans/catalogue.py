"""All registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from evigraph.plans import answers, contexts, dictionaries, evaluated, graph, normalized, records, retrieval, runs

_MODULES = (graph, answers, retrieval, records, contexts, normalized, runs, evaluated, dictionaries)


def flagship(spark, sf_dir):
    """Shortest paths from every part to every region."""
    return graph.kg_paths_topk(spark, sf_dir)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
