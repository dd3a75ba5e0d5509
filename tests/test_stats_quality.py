"""Exact distributed percentiles, quality reports, receipts and alerts."""
import numpy as np
import pytest

from riskframe.functions.stats import exact_group_percentiles, exact_percentiles
from riskframe.operators import ingest as I
from riskframe.operators import portfolio as P
from riskframe.operators import quality as Q
from riskframe.sources import io as IO
from riskframe.sources.fixtures import fixture


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(0, 1, 3000), -rng.lognormal(0, 9, 500), np.full(2000, 1.5), [np.nan, 0.0, -0.0]])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double").repartition(5)
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0, "f": 0.3333}
    got = exact_percentiles(df, "v", probs).first()
    clean = vals[~np.isnan(vals)]
    for k, p in probs.items():
        assert np.isclose(got[k], np.quantile(clean, p), rtol=1e-12, atol=1e-12)


def test_neighbouring_doubles_and_infinities(spark):
    step = np.spacing(1.0)
    vals = [float(1.0 + k * step) for k in range(40)] + [float("inf"), float("-inf")]
    got = exact_percentiles(spark.createDataFrame([(v,) for v in vals], "v double"), "v", {"lo": 0.0, "m": 0.5, "hi": 1.0}).first()
    assert got.lo == float("-inf") and got.hi == float("inf") and got.m == np.quantile(sorted(vals)[1:-1], 0.5)


@pytest.mark.parametrize("copies", [1, 200])
def test_group_percentiles_same_at_every_size(spark, copies):
    rng = np.random.default_rng(11)
    rows = ([("big", float(v)) for v in rng.normal(0, 1, 700)] + [("big", 2.0)] * 280
            + [("one", 9.0), (None, 3.0), ("nan", float("nan")), ("null", None), ("inf", float("inf"))]
            + [("small", float(v)) for v in rng.normal(5, 2, 11)])
    df = spark.createDataFrame(rows, "g string, v double").crossJoin(spark.range(copies))
    got = {r.g: r for r in exact_group_percentiles(df, "g", "v", {"m": 0.5, "q": 0.9}).collect()}
    assert set(got) == {"big", "one", "small", "inf"}  # as many rows reach the driver at either size
    for g in ("big", "one", "small"):
        vs = np.repeat(np.array([v for gg, v in rows if gg == g]), copies)
        assert abs(got[g].m - np.quantile(vs, 0.5)) < 1e-12 and abs(got[g].q - np.quantile(vs, 0.9)) < 1e-12


def test_ranks_outside_their_brackets_take_the_longer_way(spark, monkeypatch):
    from riskframe.functions import stats
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 6000)] + [("b", float(v)) for v in rng.lognormal(0, 3, 5000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    probs = {"lo": 0.0, "m": 0.5, "q": 0.9, "hi": 1.0}
    true, ways = stats._brackets, []
    whole = stats._quantiles_by_buckets

    def narrow(x, ps):  # brackets of group a lie beside the wanted ranks
        from pyspark.sql import functions as F
        b = true(x, ps)
        return b.select("g", *[F.when(F.col("g") == "a", F.lit(90.0)).otherwise(F.col(c)).alias(c) for c in b.columns[1:]])

    def by_buckets(x, *more):
        ways.append({r.g for r in x.select("g").distinct().collect()})
        return whole(x, *more)
    monkeypatch.setattr(stats, "_quantiles_by_buckets", by_buckets)
    for few in (False, True):
        for brackets, expected in ((true, []), (narrow, [{"a"}])):
            monkeypatch.setattr(stats, "_brackets", brackets)
            ways.clear()
            got = {r.g: r for r in exact_group_percentiles(df, "g", "v", probs, few_groups=few).collect()}
            for g in "ab":
                vs = np.array([v for k, v in rows if k == g])
                assert all(np.isclose(got[g][k], np.quantile(vs, p), rtol=1e-12) for k, p in probs.items())
            assert ways == expected


def test_brackets_hold_a_small_share_of_the_values(spark):
    from riskframe.functions import stats
    n = 200_000
    x = spark.range(n, numPartitions=6).selectExpr("0 AS g", "CAST(pmod(id * 7919, 200000) AS double) AS x")
    b = stats._brackets(x, [0.05, 0.5]).first()
    for lo, hi, p in ((b.lo0, b.hi0, 0.05), (b.lo1, b.hi1, 0.5)):
        assert lo < p * (n - 1) < hi and hi - lo < 4 * stats.MARGIN * n


def test_exact_percentiles_empty(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_percentiles(df, "v", {"p": 0.5}).first().p is None


def test_profile_and_completeness(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 3.0, None), (3, 4.0, "c")], "a int, b double, c string")
    prof = {r.column: r for r in Q.profile_columns(df).collect()}
    assert prof["a"].null_pct == 0.0 and abs(prof["b"].null_pct - 100 / 3) < 1e-9 and prof["c"].dtype == "string"
    comp = Q.completeness(df).first()
    assert comp.missing_cells == 2 and abs(comp.completeness_pct - 700 / 9) < 1e-9
    assert Q.duplicate_count(spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int"), "k").first().duplicates == 2


def test_receipt_status_and_errors(spark):
    rows = [(1, "C1", "e1", 30, "M", 22.0, True, False, False, "desk"),
            (2, "C1", "e2", 10, "Q", 22.0, False, False, False, "desk"),
            (3, "C2", "e3", 40, "F", 25.0, False, True, False, "field")]
    df = spark.createDataFrame(rows, "row_no int, company_id string, external_employee_id string, age int, gender string, "
                                     "bmi double, smoker boolean, diabetic boolean, hypertension boolean, job_category string")
    valid, rej = I.split_valid(I.validate_employee(df))
    r = {x.company_id: x for x in I.ingest_receipt(valid, rej).collect()}
    assert (r["C1"].records_received, r["C1"].records_stored, r["C1"].status) == (2, 1, "partial")
    assert (r["C2"].status, r["C2"].n_errors) == ("success", 0)
    errors = I.receipt_errors(rej).collect()
    assert [(e.company_id, e.row_no) for e in errors] == [("C1", 2)]
    assert errors[0].error.startswith("row_2: age") and "gender" in errors[0].error


def test_alerts_order_and_cap(spark):
    rows = [("c1", "Alpha", "Critical", 90.0, 12.0), ("c2", "Beta", "Critical", 85.0, 20.0),
            ("c3", "Gamma", "Critical", 82.0, 5.0), ("c4", "Delta", "High", 70.0, 1.0),
            ("c5", "Eps", "High", 65.0, 0.0), ("c6", "Zeta", "Low", 10.0, -10.0)]
    pf = spark.createDataFrame(rows, "company_id string, company_name string, risk_band string, mean_hrs double, "
                                     "adjustment_pct double")
    al = P.portfolio_alerts(pf).orderBy("position").collect()
    assert len(al) == 4
    assert al[0].message.startswith("Alpha, Beta +1 more")
    assert [a.band for a in al] == ["Critical", "High", "Moderate", "Moderate"]


def test_alerts_name_both_of_two_critical_companies_with_one_name(spark):
    pf = spark.createDataFrame([("c1", "Twin", "Critical", 90.0, 0.0), ("c2", "Twin", "Critical", 90.0, 0.0),
                                ("c3", "Zed", "Critical", 90.0, 0.0)],
                               "company_id string, company_name string, risk_band string, mean_hrs double, adjustment_pct double")
    assert P.portfolio_alerts(pf).orderBy("position").first().message.startswith("Twin, Twin +1 more")


def test_constraint_report_finds_orphans(spark, sf):
    comp = fixture(spark, sf, "fx_companies").where("company_id <> 'COMP_001'")
    emp = fixture(spark, sf, "fx_employees").withColumnRenamed("employee_key", "employee_id")
    rep = {(r.table, r.check): r.violations for r in IO.constraint_report({"companies": comp, "employees": emp}).collect()}
    orphans = emp.where("company_id = 'COMP_001'").count()
    assert rep[("employees", "foreign_key")] == orphans and rep[("companies", "primary_key")] == 0


def test_upload_rows_that_break_a_rule_get_reasons_and_no_score(spark):
    from riskframe.operators import scoring as S
    from riskframe.operators.model import DEFAULT_SCORECARD
    rows = [("a", 40, "F", 24.0, 0, 0, 0, "desk", 6000.0, 72.0), ("b", 40, "F", 24.0, 0, 0, 0, "desk", 99000.0, 72.0),
            ("c", 60, "M", 33.0, 1, 1, 1, "field", 2000.0, 90.0)]
    up = spark.createDataFrame(rows, "employee_id string, age int, gender string, bmi double, smoker int, diabetic int, "
                                     "hypertension int, job_category string, avg_daily_steps double, avg_resting_hr double")
    scorer = spark.createDataFrame([(-1.0, 2.0)], "p05 double, p95 double")
    got = {r.employee_id: r for r in S.score_upload(up, DEFAULT_SCORECARD, scorer).collect()}
    assert got["b"].hrs is None and got["b"].risk_band is None and "avg_daily_steps" in got["b"].errors[0]
    assert got["a"].errors == [] and got["a"].hrs < got["c"].hrs
    s = S.upload_summary(S.score_upload(up, DEFAULT_SCORECARD, scorer), 1000.0).first()
    assert s.employee_count == 2 and s.mean_hrs is not None
    none = S.upload_summary(S.score_upload(up.limit(0), DEFAULT_SCORECARD, scorer), 1000.0).first()
    assert none.employee_count == 0 and none.mean_hrs is None and none.risk_band is None


def test_hrs_distribution_in_chunks_holds_every_score(spark):
    from riskframe.operators import scoring as S
    df = spark.createDataFrame([("hot", float(i * 37 % 101)) for i in range(95)] + [("one", 5.0)], "company_id string, hrs double")
    got = S.hrs_distribution(df, chunk=10).collect()
    assert max(len(r.hrs_distribution) for r in got) == 10
    hot = [h for r in sorted(got, key=lambda r: r.chunk) if r.company_id == "hot" for h in r.hrs_distribution]
    assert hot == sorted(float(i * 37 % 101) for i in range(95))


def test_snapshot_schema_as_landed(spark):
    df = spark.createDataFrame([("e1", 40, 24.04)], "employee_id string, age int, bmi double")
    got = IO.apply_table_schema(df, "training_snapshots")
    assert got.schema.names == IO.TABLE_SCHEMAS["training_snapshots"].names
    r = got.first()
    assert str(r.bmi) == "24.0" and r.lab_heart_flag == 0 and r.computed_at is not None and r.premium_share is None
