"""Mappers, notes, alignment, partition invariance and model helpers."""
import pytest
import numpy as np
from pyspark.sql import functions as F

from riskframe.operators import mappers as M
from riskframe.operators import model as MD
from riskframe.operators import notes as N
from riskframe.sources.fixtures import fixture

NOTES = [
    (1, "### Instruction: A 67-year-old female with type 2 diabetes and HTN admitted to the ICU. "
        "BMI: 31.2. SpO2 91%. She was intubated. ### Response: ok"),
    (2, "### Instruction: Patient aged 150 but Age: 44, he is a current smoker with COPD. ### Response:"),
    (3, "no markers here; 85% to 93% on room air; man with cirrhosis"),
    (4, "### Instruction: 30 yo woman, BMI 75, depression. ### Response: his reply"),
]


def test_parse_notes_golden(spark):
    df = spark.createDataFrame(NOTES, "note_id long, text string")
    r = {x.note_id: x for x in N.parse_notes(df).collect()}
    a = r[1]
    assert (a.age, a.gender, a.bmi, a.avg_spo2) == (67.0, "F", 31.2, 91.0)
    assert (a.diabetic, a.hypertension, a.icu, a.ventilated, a.smoker) == (1, 1, 1, 1, 0)
    assert a.hospitalized_count == 2.0 and a.visit_count == min(2 + a.chronic_count + 2, 10)
    b = r[2]
    assert b.age == 44.0 and b.smoker == 1 and b.respiratory == 1 and b.gender == "M"
    c = r[3]
    assert c.age == 45.0 and c.avg_spo2 == 93.0 and c.liver_dis == 1 and c.bmi == 26.0
    d = r[4]
    assert d.age == 30.0 and d.bmi == 26.0 and d.mental == 1 and d.gender == "F"


def test_jitter_is_partition_invariant(spark, sf):
    u = fixture(spark, sf, "fx_underwriting")
    a = M.map_underwriting(u.repartition(1)).orderBy("row_key").collect()
    b = M.map_underwriting(u.repartition(7)).orderBy("row_key").collect()
    assert a == b


def test_replicate_copy_zero_unchanged(spark, sf):
    m = M.map_lab_reports(fixture(spark, sf, "fx_lab_reports"))
    r = M.replicate_lab_reports(m)
    base = {x.patient_name: x.loss_ratio for x in m.collect()}
    c0 = {x.patient_name: x.loss_ratio for x in r.where("copy = 0").collect()}
    assert base == c0
    assert r.count() == 5 * m.count()
    lr = [x.loss_ratio for x in r.collect()]
    assert min(lr) >= 0.05 and max(lr) <= 6.0


def test_replication_is_spread_and_draws_like_the_columns(spark, sf):
    from riskframe.functions.expr import keyed_uniform, keyed_uniforms
    market = M.join_market(fixture(spark, sf, "fx_market"), fixture(spark, sf, "fx_market_premium")).coalesce(1)
    r = M.replicate_market(M.map_market(market))
    assert r.select(F.spark_partition_id()).distinct().count() > 1
    keys = spark.createDataFrame([("a", 0), ("b|", 3), ("ü", 7), ("", 2), (None, 1)], "k string, copy int")
    names = ["age#u1", "age#u2", "bmi#u1"]
    for copy in ("copy", None):
        rows = keys.select(keyed_uniforms("k", names, 49, copy).alias("d"),
                           F.array(*[keyed_uniform("k", n, 49, copy) for n in names]).alias("want")).collect()
        assert len(rows) == 5 and all(x.d == x.want for x in rows)
    assert keys.where("false").select(keyed_uniforms("k", names).alias("d")).collect() == []


def test_align_distribution_matches_numpy(spark):
    vals = [(f"k{i}", float(v)) for i, v in enumerate([5.0, 1.0, 3.0, 3.0, 9.0, 0.5, 7.0])]
    ref_vals = [0.2, 0.4, 0.1, 0.9, 1.5]
    df = spark.createDataFrame(vals, "key string, loss_ratio double")
    ref = spark.createDataFrame([(v,) for v in ref_vals], "loss_ratio double")
    got = {r.key: r.loss_ratio for r in M.align_distribution(df, ref, "key", partitions=3).collect()}
    order = sorted(vals, key=lambda kv: (kv[1], kv[0]))
    n, s = len(vals), np.sort(ref_vals)
    for rank, (k, _) in enumerate(order):
        exp = np.interp((rank + 0.5) / n, np.linspace(0, 1, len(s)), s)
        assert abs(got[k] - exp) < 1e-12
    ranked = [got[k] for k, _ in order]
    assert ranked == sorted(ranked)


def test_infer_schema_kind_and_refusal(spark, sf):
    assert M.infer_schema_kind(fixture(spark, sf, "fx_underwriting")) == "underwriting_tabular"
    assert M.infer_schema_kind(fixture(spark, sf, "fx_charges")) == "insurance_charges"
    prof = spark.createDataFrame([("a", "b", 1, 2, "{}")], "name string, industry string, followers_count int, "
                                 "associated_members_count int, founded_on string")
    assert M.infer_schema_kind(prof) == "company_profiles"


def test_tolerant_union_skips_failing_source(spark, sf):
    def bad():
        return spark.read.parquet("/nonexistent/path/for/test")
    u, skipped = M.training_data("both", {"local": lambda: M.map_charges(fixture(spark, sf, "fx_charges")), "hub": bad})
    assert list(skipped) == ["huggingface"]
    assert [r[0] for r in u.select("dataset_source").distinct().collect()] == ["local"]
    with pytest.raises(Exception):
        M.training_data("hf", {"hub": bad})
    with pytest.raises(Exception):
        M.training_data("both", {"local": bad, "hub": bad})


def test_quartile_strata_dedupes_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 2, 3, 4]], "loss_ratio_log double")
    s = [r.stratum for r in MD.quartile_strata(df).orderBy("loss_ratio_log").collect()]
    assert s[0] == 0 and max(s) <= 3 and s == sorted(s)


@pytest.mark.parametrize("values", [[0.0] * 60 + [i / 7 for i in range(40)], [0.0] * 30 + [1.0] * 70,
                                    [float(i % 13) for i in range(101)]])
def test_quartile_strata_equal_qcut(spark, values):
    import pandas as pd
    df = spark.createDataFrame(list(enumerate(values)), "i int, loss_ratio_log double")
    got = [r.stratum for r in MD.quartile_strata(df).orderBy("i").collect()]
    assert got == list(pd.qcut(values, 4, labels=False, duplicates="drop"))


def test_split_takes_an_exact_share_of_every_stratum(spark):
    rows = [(f"e{i}", 0 if i < 137 else 1 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "employee_key string, stratum int")
    got = {r.stratum: (r.n, r.t) for r in MD.stratified_split(df, "employee_key").groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert sum(t for _, t in got.values()) == 80
    assert all(abs(t - n * 0.2) < 1 for n, t in got.values())
    again = MD.stratified_split(df.repartition(7), "employee_key").where("is_test").select("employee_key").collect()
    first = MD.stratified_split(df.coalesce(1), "employee_key").where("is_test").select("employee_key").collect()
    assert sorted(again) == sorted(first)
    assert MD.stratified_split(df.limit(0), "employee_key").count() == 0


def test_rank_within_hot_keys_equals_window(spark):
    from pyspark.sql import Window
    from riskframe.functions.ranks import rank_within
    rows = [("hot", i % 97, i) for i in range(3000)] + [(f"k{i % 7}", i % 5, i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, m int, id long")
    w = Window.partitionBy("key").orderBy("m", "id")
    expected = {(r.key, r.id): r.rk for r in df.withColumn("rk", F.row_number().over(w) - 1).collect()}
    got = {(r.key, r.id): r._rank for r in rank_within(df, "key", ["m", "id"], partitions=6).collect()}
    assert got == expected


def test_hr_trend_of_split_persons_matches(spark, sf):
    from riskframe.operators.rollup import hr_trend
    tele = fixture(spark, sf, "fx_telemetry")
    a = {r.employee_key: r.hr_trend for r in hr_trend(tele, partitions=1).collect()}
    b = {r.employee_key: r.hr_trend for r in hr_trend(tele, partitions=37).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_rank_within_null_keys_and_ties(spark):
    from riskframe.functions.ranks import rank_within
    rows = [(None, i % 3) for i in range(40)] + [("a", 1)] * 5
    df = spark.createDataFrame(rows, "key string, m int")
    for p in (1, 9):
        got = rank_within(df, "key", ["m"], partitions=p).collect()
        for key, n in ((None, 40), ("a", 5)):
            ranked = sorted((r._rank, r.m) for r in got if r.key == key)
            assert [x for x, _ in ranked] == list(range(n))
            assert [m for _, m in ranked] == sorted(m for _, m in ranked)
    assert rank_within(df.limit(0), "key", ["m"]).count() == 0


def test_rollup_with_missing_heart_rates(spark):
    import numpy as np
    from riskframe.operators.rollup import rollup_telemetry, rollup_telemetry_with_trend
    cols = ["avg_daily_steps", "active_minutes", "sleep_hours", "spo2"]
    rng = np.random.default_rng(3)
    rows = [(k, 1, i, f"e{k}{i}", None if i % 5 == 0 else float(60 + rng.integers(30)),
             *[float(x) for x in rng.random(4) * 9000]) for k, n in (("hot", 700), ("two", 2), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "employee_key string, month_no int, ts int, event_id string, resting_hr double, "
                                     + ", ".join(f"{c} double" for c in cols))
    ys = [(i, r[4]) for i, r in enumerate(rows[:700]) if r[4] is not None]
    slope = np.polyfit(*zip(*ys), 1)[0]
    plain = {r.employee_key: r.asDict() for r in rollup_telemetry(df).collect()}
    for p in (1, 16):
        got = {r.employee_key: r.asDict() for r in rollup_telemetry_with_trend(df, partitions=p).collect()}
        assert abs(got["hot"].pop("hr_trend") - slope) < 1e-9
        assert got["two"].pop("hr_trend") == got["one"].pop("hr_trend") == 0.0
        for k, want in plain.items():
            assert got[k].keys() == want.keys()
            for c, v in want.items():
                assert got[k][c] == v if v is None or c == "employee_key" else abs(got[k][c] - v) < 1e-7


def test_poisson_draw_equals_inverse_cdf(spark):
    import math
    from riskframe.operators.rollup import poisson_from_uniform
    rows = [(lam / 2, u / 20) for lam in range(1, 13) for u in range(20)] + [(None, 0.5)]
    df = spark.createDataFrame(rows, "lam double, u double")
    for r in df.select("lam", "u", poisson_from_uniform(F.col("lam"), F.col("u")).alias("n")).collect():
        if r.lam is None:
            assert r.n is None
            continue
        cdf, want = 0.0, 0
        for k in range(15):
            cdf += math.exp(-r.lam) * r.lam ** k / math.factorial(k)
            want += r.u > cdf
        assert r.n == want


def test_run_records_are_appended(spark, tmp_path):
    metrics = spark.createDataFrame([("train", .1, .2, .3, 8), ("test", .4, .5, .6, 2)], "split string, mae double, rmse double, r2 double, rows long")
    scorer = spark.createDataFrame([(.1, .9)], "p05 double, p95 double")
    for n in (1, 2):
        rows = spark.createDataFrame([("b", n), ("a", 1)], "source string, rows long")
        runs = MD.append_run(MD.run_record(spark, "both", metrics, scorer, rows), str(tmp_path / "runs"))
        assert [r.run for r in runs.orderBy("run").collect()] == list(range(1, n + 1))
    assert [r.rows_per_source for r in runs.orderBy("run").collect()] == ['{"a":1,"b":1}', '{"a":1,"b":2}']


def test_lab_flags_as_of_a_date(spark):
    from riskframe.operators.rollup import attach_lab_flags, latest_lab_flags
    labs = spark.createDataFrame([
        ("1", "HbA1c", "OutOfRange", "low", "2020-01-01"), ("1", "HbA1c", "normal", "low", "2020-05-01"),  # back in range
        ("1", "TSH", "normal", "low", "2020-01-01"), ("1", "TSH", "OutOfRange", "low", "2020-06-01"),      # only later
        ("2", "TSH", "normal", "low", "2020-02-01"), ("2", "TSH", "OutOfRange", "low", "2020-02-01"),      # same day
        ("2", "XYZ", "OutOfRange", "high", "2020-02-01"), ("2", "HbA1c", "OutOfRange", "low", None),
        (None, "TSH", "OutOfRange", "low", "2020-01-01")],
        "unique_id string, marker_code string, status string, risk_level string, report_date string")
    people = spark.createDataFrame([("1", 30), ("2", 40), ("3", 50), (None, 60)], "employee_key string, age int")
    got = {r.employee_key: (r.lab_diabetes_flag, r.lab_thyroid_flag, r.lab_heart_flag)
           for r in attach_lab_flags(people, labs, "2020-05-31").collect()}
    assert got == {"1": (0, 0, 0), "2": (0, 1, 0), "3": (0, 0, 0), None: (0, 0, 0)}
    assert {r._person: r.lab_thyroid_flag for r in latest_lab_flags(labs).collect()} == {"1": 1, "2": 1, None: 1}


def test_note_patterns_begin_with_their_stems():
    """The scan for stems skips no note: a match of any condition pattern begins at a boundary with one of its stems."""
    from riskframe.operators import notes as N
    for k, patterns in N.CONDITIONS.items():
        for p in patterns:
            literal = p.lower().removeprefix(r"\b")
            assert p.startswith(r"\b") and any(
                literal.startswith(w) or (k == "smoker" and w in literal) for w in N.CONDITION_STEMS[k]), p
    words = sorted({w for ws in N.CONDITION_STEMS.values() for w in ws})
    assert not [(a, b) for a in words for b in words if a != b and b.startswith(a)]
