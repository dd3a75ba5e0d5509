"""Goldens for ingestion and upload harmonisation."""
import hashlib

import pytest


from riskframe.functions.constants import DEFAULT_HASH_SALT
from riskframe.functions.expr import coerce_boolean, coerce_flag, pseudonymize
from riskframe.operators import harmonize as H
from riskframe.operators import ingest as I


def test_pseudonymize_matches_sha256(spark):
    df = spark.createDataFrame([("EMP_000001",)], "raw string")
    got = df.select(pseudonymize("raw", DEFAULT_HASH_SALT)).first()[0]
    assert got == hashlib.sha256(f"{DEFAULT_HASH_SALT}EMP_000001".encode()).hexdigest()[:16]
    assert len(got) == 16


def _wearables(spark, rows):
    schema = ("event_id long, external_employee_id string, company_id string, month_no int, steps int, "
              "restingHR int, activeMinutes int, sleepHours double, SpO2 double")
    return I.resolve_payload_aliases(spark.createDataFrame(rows, schema))


def test_wearable_defaults_and_clamps(spark):
    df = _wearables(spark, [(1, "E1", "COMP_001", 3, 0, None, None, None, None),
                            (2, "E2", "COMP_001", 3, 90000, 200, 500, 15.04, 80.0),
                            (3, "E3", "COMP_001", 3, 100, 50, 10, 7.25, 97.35)])
    r = {x.event_id: x for x in I.normalize_wearable(df, keep=["event_id"]).collect()}
    assert (r[1].avg_daily_steps, r[1].resting_hr, r[1].active_minutes, r[1].sleep_hours, r[1].spo2) == (5000, 72, 30, 7.0, 97.0)
    assert (r[2].avg_daily_steps, r[2].resting_hr, r[2].active_minutes, r[2].sleep_hours, r[2].spo2) == (30000, 110, 240, 12.0, 85.0)
    assert r[3].avg_daily_steps == 500 and r[3].sleep_hours == 7.2


def test_wearable_validation_reasons(spark):
    df = _wearables(spark, [(1, "E1", "ACME", 13, -5, 300, 1, 1.0, 1.0), (2, "E2", "COMP_002", 5, 100, 60, 1, 1.0, 1.0)])
    valid, rej = I.split_valid(I.validate_wearable(df))
    assert [r.event_id for r in valid.collect()] == [2]
    reasons = rej.first().errors
    assert len(reasons) == 4 and any("month" in x for x in reasons) and any("heart rate" in x for x in reasons)


def test_upsert_keeps_gender_and_company(spark):
    target = spark.createDataFrame([("a", "C1", 30, "M", 20.0, 0, 0, 0, "desk")],
                                   "employee_id string, company_id string, age int, gender string, bmi double, "
                                   "smoker int, diabetic int, hypertension int, job_category string")
    batch = spark.createDataFrame([(1, "a", "C9", 40, "F", 25.0, 1, 1, 1, "field"),
                                   (2, "a", "C9", 41, "F", 26.0, 1, 0, 1, "manual"),
                                   (3, "b", "C9", 50, "O", 30.0, 0, 0, 0, "desk")],
                                  "row_no int, employee_id string, company_id string, age int, gender string, "
                                  "bmi double, smoker int, diabetic int, hypertension int, job_category string")
    out = {r.employee_id: r for r in I.upsert_roster(target, batch).collect()}
    assert (out["a"].company_id, out["a"].gender) == ("C1", "M")
    assert (out["a"].age, out["a"].job_category, out["a"].diabetic) == (41, "manual", 0)
    assert out["b"].company_id == "C9"


def test_boolean_coercion(spark):
    vals = ["yes", " TRUE ", "0", "n/a", "2", "No", None, "-1", "1.0"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(coerce_boolean("v")).collect()]
    assert got == [1, 1, 0, 0, 1, 0, 0, 0, 1]
    fb = [r[0] for r in df.select(coerce_flag("v", 1)).collect()]
    assert fb == [1, 1, 0, 1, 1, 0, 1, 0, 1]


def test_map_columns_first_alias_wins(spark):
    df = spark.createDataFrame([("1", "M", "2", "3")], "`Emp ID` string, SEX string, `Member ID` string, colour string")
    _, mapping, unmapped = H.map_columns(df)
    assert mapping == {"Emp ID": "employee_id", "SEX": "gender"}
    assert unmapped == ["Member ID", "colour"]


def test_detect_format(spark):
    mk = lambda cols: spark.createDataFrame([tuple("x" for _ in cols)], ", ".join(f"`{c}` string" for c in cols))
    assert H.detect_format(mk(["Marker Code", "value", "unique_id"])) == "lab"
    assert H.detect_format(mk(["user_id", "step_count", "Heart Health"])) == "activity"
    assert H.detect_format(mk(["employee_id", "age"])) == "roster"
    assert H.detect_format(mk(["foo"])) == "unknown"


def test_pivot_labs_golden(spark):
    rows = [(1, 1, "u1", "HbA1c", "OutOfRange", "low", "female"),
            (1, 2, "u1", "ldl", "normal", "Medium", None),
            (2, 1, "u2", "Hb", None, "low", None),
            (2, 2, "u2", "XYZ", "high", "low", None)]
    df = spark.createDataFrame(rows, "report_id long, line_no int, unique_id string, marker_code string, "
                                     "status string, risk_level string, gender string")
    r = {x.employee_id: x for x in H.pivot_labs(df).collect()}
    assert r["u1"].lab_diabetes_flag == 1 and r["u1"].lab_heart_flag == 1 and r["u1"].gender == "F"
    assert r["u1"].hypertension_inferred == 0 and r["u1"].diabetic_inferred == 1
    assert r["u2"].lab_iron_flag == 0 and r["u2"].gender is None
    assert sum(r["u2"][f"lab_{d}_flag"] for d in ["heart", "iron", "diabetes"]) == 0


def test_harmonize_rejects_bad_loss_ratio(spark, sf):
    from riskframe.plans.catalog_harmonize import upload
    from riskframe.plans.catalog_core import snapshot
    rows, report, _ = H.harmonize(upload(spark, sf), snapshot(spark, sf))
    assert rows.count() == 0
    assert report.first().non_numeric > 0


def test_fill_defaults_only_absent_columns(spark, sf):
    from riskframe.plans.catalog_core import snapshot
    up = spark.createDataFrame([("x1", None, "2.0"), ("x2", "F", "0.5")], "`Emp ID` string, SEX string, LR string")
    rows, report, info = H.harmonize(up, snapshot(spark, sf))
    r = {x.employee_id: x for x in rows.collect()}
    assert r["x1"].gender == "O" and r["x2"].gender == "F"          # null cell normalised, not defaulted
    assert r["x1"].company_id == "UPLOAD" and r["x1"].high_risk == 1 and r["x2"].high_risk == 0
    assert "age" in info["filled_with_defaults"] and "gender" not in info["filled_with_defaults"]
    assert r["x1"].age == r["x2"].age  # the reference median


def test_activity_active_minutes_fallback(spark):
    df = spark.createDataFrame([(1, 3650.0, 0.0, 730.0, "outofrange"), (2, None, None, 365.0, "inrange")],
                               "user_id long, step_count double, total_active_minutes double, "
                               "steps_active_minutes double, diabetes string")
    r = {x.employee_id: x for x in H.map_activity(df).collect()}
    assert r["1"].avg_daily_steps == 3650.0 and r["1"].avg_active_mins == 2.0 and r["1"].lab_diabetes_flag == 1
    assert r["2"].avg_active_mins is None and r["2"].diabetic_inferred == 0


def test_fill_report_lists_defaulted_fields(spark, sf):
    from riskframe.plans.catalog_core import snapshot
    labs = spark.createDataFrame([(1, 1, "u1", "HbA1c", "high", "low", None)],
                                 "report_id long, line_no int, unique_id string, marker_code string, status string, "
                                 "risk_level string, gender string")
    rows = H.to_feature_rows(H.pivot_labs(labs), H.population_defaults(snapshot(spark, sf)))
    rep = H.fill_report(rows, "lab").first()
    assert rep.rows == 1 and set(rep.filled_with_defaults) >= {"age", "bmi", "gender", "job_category", "smoker"}
    assert rows.first().diabetic == 1


def test_generated_ids_are_unique_for_equal_rows(spark):
    df = spark.createDataFrame([(30.0, "M")] * 40 + [(41.0, "F")], "age double, gender string")
    ref = spark.createDataFrame([(30.0, "M", "Manual", 20.0)], "age double, gender string, job_category string, bmi double")
    ids = [r.employee_id for r in H.fill_defaults(df.repartition(5), ref).select("employee_id").collect()]
    assert len(set(ids)) == 41
    again = [r.employee_id for r in H.fill_defaults(df.coalesce(1), ref).select("employee_id").collect()]
    assert sorted(ids) == sorted(again)


def test_checkpoint_folder_is_required_off_local_masters():
    from riskframe.session import ensure_checkpoint_dir

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_release_deletes_intermediate_tables(spark):
    import os

    from riskframe import session
    session.materialize(spark.range(3), "probe")
    path = session._TABLES[-1]
    assert os.path.isdir(path) and session.release(spark) >= 1
    assert not os.path.exists(path) and session.release(spark) == 0


def test_training_modes(spark):
    from riskframe.operators import mappers as M
    one, two = (spark.createDataFrame(rows, "employee_id string, loss_ratio double")
                for rows in ([("a", 1.0)], [("b", 5.0), ("c", 9.0)]))
    fail = lambda: spark.read.parquet("/nowhere/at/all")
    out, skipped = M.training_data("both", {"local": lambda: one, "hub": fail})
    assert out.count() == 1 and list(skipped) == ["huggingface"]
    with pytest.raises(ValueError):
        M.training_data("other", {})
    with pytest.raises(Exception):
        M.training_data("hf", {"hub": fail})
    out, _ = M.training_data("excel-aug-lab", {"excel_augmented": lambda: two, "lab_augmented": lambda: one})
    got = {(r.dataset_source, r.loss_ratio) for r in out.collect()}
    assert got == {("excel", 5.0), ("excel", 9.0), ("clinical_lab", 7.0)}


def test_feature_records_of_every_format(spark):
    import pytest
    from riskframe.operators import harmonize as H
    base = H.constant_defaults(spark)
    d = base.first()
    lab = spark.createDataFrame([("7", "HbA1c", "1", "OutOfRange", None, "f", 1, 1)],
                                "unique_id string, marker_code string, value string, status string, risk_level string, gender string, "
                                "report_id int, line_no int")
    rows, kind = H.feature_records(lab, base, {"bmi": 31.5})
    r = rows.first()
    assert kind == "lab" and (r.employee_id, r.gender, r.bmi, r.diabetic, r.hypertension, r.age) == ("7", "F", 31.5, 1, 0, d.age)
    activity = spark.createDataFrame([("u", 1234.0, "outofrange", None)], "user_id string, step_count double, heart_health string, diabetes string")
    rows, kind = H.feature_records(activity, base)
    r = rows.first()
    assert kind == "activity" and (r.employee_id, r.avg_daily_steps, r.hypertension, r.diabetic) == ("u", 1234.0, 1, 0)
    roster = spark.createDataFrame([("a", "33", "female", "99", "yes", "MANUAL"), ("b", "x", "?", "22.5", None, None)],
                                   "` Employee_ID` string, Age string, GENDER string, bmi string, Smoker string, Job_Category string")
    rows, kind = H.feature_records(roster, base, {"age": 38, "smoker": 1, "job_category": "field"})
    a, b = rows.orderBy("employee_id").collect()
    assert kind == "roster"
    assert (a.age, a.gender, a.bmi, a.smoker, a.job_category) == (33, "F", d.bmi, 1, "manual")
    assert (b.age, b.gender, b.bmi, b.smoker, b.job_category) == (38, d.gender, 22.5, 1, "field")
    with pytest.raises(ValueError, match="no such default: height"):
        H.feature_records(roster, base, {"height": 1})
