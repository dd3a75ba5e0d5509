"""The driver contract in __spark_entry__.py."""
import __spark_entry__ as entry_mod


def test_entry_flagship_rows(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"company_id", "mean_hrs", "risk_band", "adjusted", "zone"} <= set(df.columns)


def test_queries_and_oracles_align():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert len(q) >= 130 and set(o) <= set(q)
    assert all(callable(f) and f.__doc__ for f in q.values())
    assert all(isinstance(s, str) and "SELECT" in s.upper() for s in o.values())


def test_every_family_is_registered():
    names = " ".join(entry_mod.queries())
    for fam in ["src", "snk", "ing", "hrm", "agg", "map", "fea", "mod", "sco", "prc", "prt", "dq", "fai", "par",
                "jit", "str"]:
        assert f"{fam}" in names, fam
