import sys

import __spark_entry__ as entry
from cairnspark.plans import oracle, registry


def test_without_the_training_data_operators(monkeypatch):
    """Everything else is registered where they cannot be imported."""
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("cairnspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry.queries() == registry.QUERIES and entry.oracle_sql() == oracle.ORACLES


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
