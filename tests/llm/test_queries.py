from lodestone.llm import queries as Q


def test_registered():
    named, checked = Q.queries(), Q.oracle_sql()
    assert sorted(n.split("_")[0] for n in named) == sorted(["pipeline", *(f"op{i}" for i in range(1, 11))])
    assert set(checked) <= set(named) and all(isinstance(s, str) for s in checked.values())
