"""kgflow: knowledge-graph question-answering data work as lazy Spark DataFrames.

Subpackages
-----------
sources    readers/writers, the table -> triples mapping, derived fixtures
operators  graph-query operators over a triples table, vector linking,
           query-graph equivalence
functions  Column functions: logical-form text cleaning, scoring, prompts
plans      composed flagship queries and their DuckDB oracle SQL
streaming  the stateless/additive operators over ``readStream``
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Executors need no installed copy of this package: functions that run in
    Python workers (Arrow batches) are pickled by value."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
