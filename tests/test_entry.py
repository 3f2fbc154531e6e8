import builtins
import sys

import __spark_entry__


def test_core_queries_remain_without_the_libraries_of_the_subpackage(monkeypatch):
    real = builtins.__import__

    def gate(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for module in [m for m in sys.modules if m == "ahocorasick" or m.startswith("tasselworks.llm")]:
        monkeypatch.delitem(sys.modules, module)
    monkeypatch.setattr(builtins, "__import__", gate)
    names = set(__spark_entry__.queries())
    assert names == set(__spark_entry__.registry().fns) and len(names) > 100
    assert set(__spark_entry__.oracle_sql()) <= names
