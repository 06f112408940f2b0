"""The entry points without the text queries."""

import sys

import __spark_entry__ as entry
from geopatch.plans import queries as plans


def test_the_engine_stays_where_text_queries_cannot_be_imported(monkeypatch):
    monkeypatch.setitem(sys.modules, "geopatch.llm.queries", None)
    monkeypatch.delattr("geopatch.llm.queries", raising=False) if "geopatch.llm" in sys.modules else None
    assert entry.queries().keys() == plans.QUERIES.keys()
    assert entry.oracle_sql().keys() == plans.SQL.keys()


def test_every_query_has_an_oracle_or_is_known_to_have_none():
    assert set(plans.QUERIES) - set(plans.SQL) == {"gbt_leafwise"}
