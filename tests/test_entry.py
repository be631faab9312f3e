"""The entry stands without the optional subpackage and without what it needs."""

import builtins
import sys

import __spark_entry__ as entry
from factloom.tables import all_queries


def test_other_queries_stay_without_tokenizers(monkeypatch):
    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name == "public_tokenizers" or name.startswith("factloom.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith("factloom.llm") or n in ("public_tokenizers", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", blocked)
    assert entry.queries() == dict(all_queries.QUERIES) and entry.oracle_sql() == dict(all_queries.ORACLES)
