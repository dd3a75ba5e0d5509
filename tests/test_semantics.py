"""Goldens for the semantic traps listed in SURVEY section 5."""
from pyspark.sql import functions as F

from riskframe.operators import harmonize as H
from riskframe.operators import ingest as I
from riskframe.operators import pricing as R


def test_premium_pct_semantics_with_multiplier(spark):
    df = spark.createDataFrame([(100000.0, 20.0, 1.2), (100000.0, 50.0, 1.2), (100000.0, 80.0, 1.2)],
                               "base_premium double, hrs double, m double")
    r = R.adjust_premium(df, "base_premium", "hrs", F.col("m")).orderBy("hrs").collect()
    # discount/loading pct exclude the multiplier; standard pct is the multiplier's effect only
    assert (r[0].zone, r[0].adjustment_pct, r[0].adjusted_premium) == ("discount", -7.5, 111000.0)
    assert (r[1].zone, r[1].adjustment_pct, r[1].adjusted_premium) == ("standard", 20.0, 120000.0)
    assert (r[2].zone, r[2].adjustment_pct, r[2].adjusted_premium) == ("loading", 15.0, 138000.0)
    # zone edges are continuous at 40 and 60
    e = spark.createDataFrame([(1.0, 40.0), (1.0, 60.0), (1.0, 60.01)], "base_premium double, hrs double")
    assert [x.zone for x in R.adjust_premium(e).orderBy("hrs").collect()] == ["discount", "standard", "loading"]


def test_money_and_total_formats(spark):
    df = spark.createDataFrame([(999.456,), (123456.5,)], "v double")
    usd = [x[0] for x in df.select(R.format_money("v", "USD")).collect()]
    jpy = [x[0] for x in df.select(R.format_money("v", "JPY")).collect()]
    assert usd == ["$999.46", "$123,456"] and jpy == ["¥999", "¥123,456"]
    t = spark.createDataFrame([(2.5e9,)], "v double")
    inr = t.select(R.format_total("v", "INR")).first()[0]
    usd_t = t.select(R.format_total("v", "USD")).first()[0]
    assert inr == "₹250.00\u00a0Cr" and usd_t == "$29.95\u00a0M"


def test_sum_assured_bands(spark):
    df = spark.createDataFrame([(3.0,), (3.5,), (7.0,), (15.0,), (15.5,)], "s double")
    assert [x[0] for x in df.select(R.sum_assured_band("s")).collect()] == ["1-3L", "4-7L", "4-7L", "8-15L", "15L+"]


def test_alias_precedence_canonical_wins(spark):
    df = spark.createDataFrame([(1, 2, None, 3)], "daily_steps int, steps int, heart_rate_rest int, restingHR int")
    r = I.resolve_payload_aliases(df).first()
    assert r.daily_steps == 1 and r.heart_rate_rest == 3 and "steps" not in I.resolve_payload_aliases(df).columns


def test_out_of_range_spellings(spark):
    rows = [("OutOfRange", None), ("low", None), ("normal", "Medium"), ("normal", "low"), (None, "critical"),
            (" HIGH ", None), ("ok", "med")]
    df = spark.createDataFrame(rows, "status string, risk_level string")
    got = [x[0] for x in df.select(H.is_out_of_range("status", "risk_level")).collect()]
    assert got == [True, True, True, False, True, True, True]


def test_marker_code_normalisation(spark):
    df = spark.createDataFrame([("Vit-B12",), ("hs-CRP",), ("HDL ",), ("Uric Acid",), ("XYZ",)], "marker_code string")
    got = [x.domain for x in H.marker_domain(df).collect()]
    assert sorted(got, key=str) == sorted(["vitamin", "inflammation", "heart", "kidney", None], key=str)


def test_flagship_partition_invariance(spark, sf):
    from riskframe.plans.registry import load_all, run
    load_all()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(run("prt3_portfolio", spark, sf).collect()))
            results.append(sorted(run("map11_align_distribution", spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[2] == results[4]
    assert results[1] == results[3] == results[5]


def test_principals_decide_access(spark):
    from riskframe.operators import portfolio as P
    people = spark.createDataFrame([("u", "underwriter", None), ("h", "hr_admin", "C1"), ("n", "hr_admin", None), ("v", "viewer", "C1")],
                                   "principal string, role string, company_id string")
    ask = spark.createDataFrame([(p, c) for p in ("u", "h", "n", "v", "x") for c in ("C1", "C2", None)], "principal string, company_id string")
    got = {(r.principal, r.company_id): r.reason if not r.allowed else True for r in P.access_decisions(ask, people).collect()}
    denied = "Access denied for this company"
    none = "hr_admin account has no company_id configured"
    assert got == {("u", "C1"): True, ("u", "C2"): True, ("u", None): True, ("h", "C1"): True, ("h", "C2"): denied, ("h", None): True,
                   **{("n", c): none for c in ("C1", "C2", None)}, **{("v", c): "role without access" for c in ("C1", "C2", None)},
                   **{("x", c): "unknown principal" for c in ("C1", "C2", None)}}
    rows = spark.createDataFrame([("C1",), ("C2",), (None,)], "company_id string")
    see = lambda p: sorted(str(r.company_id) for r in P.visible_rows(rows, people, p).collect())
    assert [see(p) for p in "uhnvx"] == [["C1", "C2", "None"], ["C1"], [], [], []]


def test_scorer_state_is_restored(spark):
    from riskframe.operators import scoring as S
    saved = S.scorer_state(spark.createDataFrame([(0.5, 1.5)], "p05 double, p95 double"))
    rows = spark.createDataFrame([(0.75,)], "log_pred double")
    assert S.score_hrs(rows, S.restore_scorer(saved)).first().hrs == 25.0
    never = spark.createDataFrame([(0.5, 1.5, False)], "p05 double, p95 double, fitted boolean")
    assert S.score_hrs(rows, S.restore_scorer(never)).first().hrs == 50.0


def test_range_partitions_follow_the_input(spark, tmp_path):
    from riskframe.functions.ranks import range_partitions
    path = str(tmp_path / "t")
    spark.range(200_000).write.parquet(path)
    t = spark.read.parquet(path)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert range_partitions(t) == range_partitions(t.join(t.withColumnRenamed("id", "k"), t["id"] == 1)) == least
    assert range_partitions(t.selectExpr("id * 2 AS x"), target=10_000) > 50
