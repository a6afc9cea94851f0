import pytest

from lodestone import queries as core
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_matches_oracle(spark, sf_dir, name):
    assert_same(core.queries()[name](spark, sf_dir), sf_dir, core.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(core.queries()) <= set(__spark_entry__.queries())


def test_entry_survives_a_library_that_only_the_text_operators_need(monkeypatch):
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("lodestone.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lodestone.llm.queries", None)  # importing it raises ImportError
    import lodestone

    monkeypatch.delattr(lodestone, "llm", raising=False)
    assert set(__spark_entry__.queries()) == set(core.queries())
    assert set(__spark_entry__.oracle_sql()) == set(core.oracle_sql())
