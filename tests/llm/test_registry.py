"""A broken import inside the subpackage hides its queries: all of them must be registered."""

import importlib.util
import os

import kgflow


def test_every_corpus_query_is_registered(spark):
    root = os.path.dirname(os.path.dirname(kgflow.__file__))
    spec = importlib.util.spec_from_file_location("spark_entry_llm", os.path.join(root, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    names = [q for q in m.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in m.queries()
