"""Registered queries: ingestion validation, normalisation, referential checks, upsert (ING*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_HASH_SALT, EVENT_TYPES
from ..functions.expr import pseudonymize
from ..operators import ingest as I
from ..sources.fixtures import fixture
from .catalog_core import snapshot
from .oracle_sql import CORE_FIXTURES, SNAPSHOT_CTES, rnd, with_fixtures
from .registry import register

SALT = DEFAULT_HASH_SALT


def _pseudo_sql(c):
    return f"substr(sha256('{SALT}' || {c}), 1, 16)"


def reasons_sql(rules):
    items = ", ".join(f"CASE WHEN coalesce({cond}, false) THEN '{reason}' END" for cond, reason in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def _clamp_sql(v, lo, hi):
    return f"(CASE WHEN {v} IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {v})) END)"


# ---- wearables ----------------------------------------------------------------------------

_WEAR_RULES = [
    ("external_employee_id IS NULL", "external_employee_id: field required"),
    ("company_id IS NULL", "company_id: field required"),
    ("month_no IS NULL", "month_no: field required"),
    ("NOT regexp_matches(company_id, '^COMP_\\d{3}$')", "company_id: must match ^COMP_\\d{3}$"),
    ("(month_no < 1 OR month_no > 12)", "month: must be between 1 and 12"),
    ("(steps < 0 OR steps > 100000)", "daily_steps: step count out of sensor range"),
    ("(restingHR < 30 OR restingHR > 220)", "heart_rate_rest: heart rate out of physiological range"),
]
_WEAR = with_fixtures(["fx_wearable_payload", "fx_employees", "fx_companies"]) + f"""
, v AS (SELECT *, {reasons_sql(_WEAR_RULES)} AS errors FROM fx_wearable_payload)"""


def _wear_sql(src, default, lo, hi, dec):
    v = f"coalesce(CASE WHEN {src} <> 0 THEN {src} END, {default})"
    if dec is None:
        return f"CAST({_clamp_sql(f'CAST({v} AS INTEGER)', lo, hi)} AS INTEGER)"
    return f"round_even({_clamp_sql(f'CAST({v} AS DOUBLE)', f'{lo}e0', f'{hi}e0')}, {dec})"


_WEAR_NORM = f"""
, wn AS (
  SELECT event_id, {_pseudo_sql('external_employee_id')} AS employee_id, company_id, CAST(month_no AS INTEGER) AS month_no,
         {_wear_sql('steps', 5000, 500, 30000, None)} AS avg_daily_steps,
         {_wear_sql('restingHR', 72, 45, 110, None)} AS resting_hr,
         {_wear_sql('activeMinutes', 30, 0, 240, None)} AS active_minutes,
         {_wear_sql('sleepHours', '7.0', '3.0', '12.0', 1)} AS sleep_hours,
         {_wear_sql('SpO2', '97.0', '85.0', '100.0', 1)} AS spo2
  FROM v WHERE len(errors) = 0)"""


def wearable_checked(spark, sf):
    return I.validate_wearable(I.resolve_payload_aliases(fixture(spark, sf, "fx_wearable_payload")))


def wearable_normalized(spark, sf):
    valid, _ = I.split_valid(wearable_checked(spark, sf))
    return I.normalize_wearable(valid, SALT, keep=["event_id"])


@register("ing7_validate_wearable", oracle=_WEAR + """
SELECT event_id, array_to_string(errors, '; ') AS reasons FROM v WHERE len(errors) > 0""")
def q_validate_wearable(spark, sf):
    """ING7 (+ING13): wearable payloads rejected by validation, with every reason."""
    _, rej = I.split_valid(wearable_checked(spark, sf))
    return rej.select("event_id", F.array_join("errors", "; ").alias("reasons"))


@register("ing3_normalize_wearable", oracle=_WEAR + _WEAR_NORM + "\nSELECT * FROM wn",
          floats=["sleep_hours", "spo2"])
def q_normalize_wearable(spark, sf):
    """ING3/ING6 (+ING1, ING2, ING7, ING13): valid wearable payloads normalised (missing or zero -> default, null-safe clamps)."""
    return wearable_normalized(spark, sf)


_EMP_IDS = f"(SELECT {_pseudo_sql('raw_id')} AS employee_id FROM fx_employees)"


@register("ing14_require_company", oracle=_WEAR + _WEAR_NORM + """
SELECT event_id, company_id, company_id IN (SELECT company_id FROM fx_companies) AS company_known FROM wn""")
def q_require_company(spark, sf):
    """ING14: normalised wearables split into known-company (semi join) and unknown-company (anti join) rows."""
    wn = wearable_normalized(spark, sf)
    ok, bad = I.require_company(wn, fixture(spark, sf, "fx_companies"))
    return ok.select("event_id", "company_id", F.lit(True).alias("company_known")).unionByName(
        bad.select("event_id", "company_id", F.lit(False).alias("company_known")))


STREAMED_WEARABLES_SQL = _WEAR + _WEAR_NORM + f"""
SELECT * FROM wn WHERE company_id IN (SELECT company_id FROM fx_companies) AND employee_id IN {_EMP_IDS}"""


@register("ing15_require_employee", oracle=_WEAR + _WEAR_NORM + f"""
SELECT event_id, employee_id FROM wn WHERE company_id IN (SELECT company_id FROM fx_companies)
  AND employee_id IN {_EMP_IDS}""")
def q_require_employee(spark, sf):
    """ING14 + ING15: wearables that pass the company and the employee existence checks (ready to append)."""
    wn = wearable_normalized(spark, sf)
    ok, _ = I.require_company(wn, fixture(spark, sf, "fx_companies"))
    emp = fixture(spark, sf, "fx_employees").select(pseudonymize("raw_id", SALT).alias("employee_id"))
    good, _ = I.require_employee(ok, emp)
    return good.select("event_id", "employee_id")


# ---- clinical -------------------------------------------------------------------------------

_CLIN_RULES = [
    ("external_employee_id IS NULL", "external_employee_id: field required"),
    ("company_id IS NULL", "company_id: field required"),
    ("month_no IS NULL", "month_no: field required"),
    ("event_type IS NULL", "event_type: field required"),
    ("icd10_code IS NULL", "icd10_code: field required"),
    ("claim_amount IS NULL", "claim_amount: field required"),
    ("NOT regexp_matches(company_id, '^COMP_\\d{3}$')", "company_id: must match ^COMP_\\d{3}$"),
    ("NOT event_type IN (" + ", ".join(f"'{e}'" for e in EVENT_TYPES) + ")", "event_type: not a known event type"),
    ("length(icd10_code) > 10", "icd10_code: at most 10 characters"),
    ("(claim_amount < 0 OR claim_amount > 5000000)", "claim_amount: must be 0..5000000"),
    ("(month_no < 1 OR month_no > 12)", "month: must be between 1 and 12"),
]
_CLIN = with_fixtures(["fx_clinical_payload"]) + f"""
, v AS (SELECT *, {reasons_sql(_CLIN_RULES)} AS errors FROM fx_clinical_payload)"""


@register("ing8_validate_clinical", oracle=_CLIN + """
SELECT payload_id, array_to_string(errors, '; ') AS reasons FROM v WHERE len(errors) > 0""")
def q_validate_clinical(spark, sf):
    """ING8: clinical payloads rejected by validation, with every reason."""
    _, rej = I.split_valid(I.validate_clinical(fixture(spark, sf, "fx_clinical_payload")))
    return rej.select("payload_id", F.array_join("errors", "; ").alias("reasons"))


_CLIN_NORM = f"""
, cn AS (
  SELECT payload_id,
         'EVT_' || upper(substr(sha256(concat_ws('|', external_employee_id, company_id, CAST(month_no AS VARCHAR), event_type,
                icd10_code, CAST(claim_amount AS VARCHAR))), 1, 16)) AS event_id,
         {_pseudo_sql('external_employee_id')} AS employee_id, company_id, CAST(month_no AS INTEGER) AS month_no, event_type,
         upper(trim(icd10_code)) AS icd10_code, {rnd('claim_amount', 2)} AS claim_amount,
         coalesce(CAST(hospitalized AS INTEGER), 0) AS hospitalized
  FROM v WHERE len(errors) = 0)"""
STREAMED_CLINICAL_SQL = _CLIN.replace(with_fixtures(["fx_clinical_payload"]),
                                      with_fixtures(["fx_clinical_payload", "fx_employees", "fx_companies"])) + _CLIN_NORM + f"""
SELECT * FROM (SELECT * FROM cn QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY payload_id) = 1)
WHERE company_id IN (SELECT company_id FROM fx_companies) AND employee_id IN {_EMP_IDS}"""


@register("ing4_normalize_clinical", oracle=_CLIN + _CLIN_NORM + "\nSELECT * FROM cn", floats=["claim_amount"])
def q_normalize_clinical(spark, sf):
    """ING4 (+ING8): valid clinical payloads normalised, with an idempotent event id."""
    valid, _ = I.split_valid(I.validate_clinical(fixture(spark, sf, "fx_clinical_payload")))
    return I.normalize_clinical(valid, SALT, keep=["payload_id"])


# ---- roster ---------------------------------------------------------------------------------

_EMP_RULES = [
    ("external_employee_id IS NULL", "external_employee_id: field required"),
    ("age IS NULL", "age: field required"), ("gender IS NULL", "gender: field required"),
    ("bmi IS NULL", "bmi: field required"), ("job_category IS NULL", "job_category: field required"),
    ("(age < 18 OR age > 70)", "age: must be between 18 and 70"),
    ("NOT gender IN ('M', 'F', 'O')", "gender: must be one of M, F, O"),
    ("(bmi < 10 OR bmi > 60)", "bmi: must be between 10 and 60"),
    ("NOT job_category IN ('desk', 'field', 'manual')", "job_category: must be one of desk, field, manual"),
]
_ROSTER = with_fixtures(["fx_roster_payload", "fx_employees"]) + f"""
, v AS (SELECT *, {reasons_sql(_EMP_RULES)} AS errors FROM fx_roster_payload),
bn AS (SELECT row_no, {_pseudo_sql('external_employee_id')} AS employee_id, company_id,
              CAST(greatest(18, least(70, age)) AS INTEGER) AS age, gender,
              round_even(greatest(10e0, least(60e0, bmi)), 1) AS bmi, CAST(smoker AS INTEGER) AS smoker,
              CAST(diabetic AS INTEGER) AS diabetic, CAST(hypertension AS INTEGER) AS hypertension, job_category
       FROM v WHERE len(errors) = 0)"""


def roster_checked(spark, sf):
    return I.validate_employee(fixture(spark, sf, "fx_roster_payload"))


@register("ing9_validate_employee", oracle=_ROSTER + """
SELECT row_no, array_to_string(errors, '; ') AS reasons FROM v WHERE len(errors) > 0""")
def q_validate_employee(spark, sf):
    """ING9: roster rows rejected by validation, with every reason."""
    _, rej = I.split_valid(roster_checked(spark, sf))
    return rej.select("row_no", F.array_join("errors", "; ").alias("reasons"))


@register("ing5_normalize_employee", oracle=_ROSTER + "\nSELECT * FROM bn", floats=["bmi"])
def q_normalize_employee(spark, sf):
    """ING5 (+ING9): valid roster rows normalised (clamps, 0/1 flags, pseudonymised id)."""
    valid, _ = I.split_valid(roster_checked(spark, sf))
    return I.normalize_employee(valid, SALT, keep=["row_no"])


@register("ing10_batch_size", oracle=with_fixtures(["fx_roster_payload"]) + """
SELECT company_id, count(*) AS members, count(*) BETWEEN 1 AND 1000 AS valid FROM fx_roster_payload GROUP BY company_id""")
def q_batch_size(spark, sf):
    """ING10: roster batches (one per company) must hold 1..1000 members."""
    return I.validate_batch_size(fixture(spark, sf, "fx_roster_payload"))


def _target_roster(spark, sf):
    e = fixture(spark, sf, "fx_employees")
    return e.select(pseudonymize("raw_id", SALT).alias("employee_id"), "company_id", "age", "gender", "bmi",
                    "smoker", "diabetic", "hypertension", "job_category")


UPSERTED_SQL = _ROSTER + f"""
, b AS (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY row_no DESC) = 1),
t AS (SELECT {_pseudo_sql('raw_id')} AS employee_id, company_id, age, gender, bmi, smoker, diabetic, hypertension,
             job_category FROM fx_employees)
SELECT coalesce(t.employee_id, b.employee_id) AS employee_id, coalesce(t.company_id, b.company_id) AS company_id,
       CASE WHEN b.employee_id IS NOT NULL THEN b.age ELSE t.age END AS age,
       coalesce(t.gender, b.gender) AS gender,
       CASE WHEN b.employee_id IS NOT NULL THEN b.bmi ELSE t.bmi END AS bmi,
       CASE WHEN b.employee_id IS NOT NULL THEN b.smoker ELSE t.smoker END AS smoker,
       CASE WHEN b.employee_id IS NOT NULL THEN b.diabetic ELSE t.diabetic END AS diabetic,
       CASE WHEN b.employee_id IS NOT NULL THEN b.hypertension ELSE t.hypertension END AS hypertension,
       CASE WHEN b.employee_id IS NOT NULL THEN b.job_category ELSE t.job_category END AS job_category
FROM t FULL OUTER JOIN b ON t.employee_id = b.employee_id"""


@register("ing17_upsert_roster", oracle=UPSERTED_SQL, floats=["bmi"])
def q_upsert(spark, sf):
    """ING17 (+ING5, ING9): roster upsert: last batch row per person wins; gender and company never change."""
    valid, _ = I.split_valid(roster_checked(spark, sf))
    batch = I.normalize_employee(valid, SALT, keep=["row_no"])
    return I.upsert_roster(_target_roster(spark, sf), batch, "employee_id", "row_no")


@register("ing18_ingest_receipt", oracle=_ROSTER + """
SELECT company_id, row_no, 'row_' || CAST(row_no AS VARCHAR) || ': ' || array_to_string(errors, '; ') AS error
FROM v WHERE len(errors) > 0""")
def q_receipt(spark, sf):
    """ING18: the error lines of every company's roster receipt, one row each."""
    _, rej = I.split_valid(roster_checked(spark, sf))
    return I.receipt_errors(rej, "company_id", "row_no")


@register("ing18_receipt_counts", oracle=_ROSTER + """
SELECT company_id, count(*) AS records_received, count(*) FILTER (WHERE len(errors) = 0) AS records_stored,
       count(*) FILTER (WHERE len(errors) > 0) AS n_errors,
       CASE WHEN count(*) FILTER (WHERE len(errors) > 0) = 0 THEN 'success' ELSE 'partial' END AS status
FROM v GROUP BY company_id""")
def q_receipt_counts(spark, sf):
    """ING18: receipt counts and status per company batch."""
    valid, rej = I.split_valid(roster_checked(spark, sf))
    return I.ingest_receipt(valid, rej, "company_id")


# ---- scoring / pricing requests --------------------------------------------------------------

SCORING_RULES = [
    ("age IS NULL", "age: field required"), ("gender IS NULL", "gender: field required"),
    ("bmi IS NULL", "bmi: field required"), ("avg_daily_steps IS NULL", "avg_daily_steps: field required"),
    ("avg_resting_hr IS NULL", "avg_resting_hr: field required"),
    ("NOT gender IN ('M', 'F', 'O')", "gender: must be one of M, F, O"),
] + [(f"({c} < {lo}" + (f" OR {c} > {hi})" if hi is not None else ")"),
      f"{c}: must be between {lo} and {hi}" if hi is not None else f"{c}: must be >= {lo}")
     for c, lo, hi in I.SCORING_RANGES]


@register("ing11_validate_scoring", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + f"""
, r AS (SELECT employee_key, age, gender, bmi, avg_daily_steps, coalesce(step_volatility, 0e0) AS step_volatility,
               avg_resting_hr, coalesce(avg_active_mins, 30e0) AS avg_active_mins,
               coalesce(avg_sleep_hours, 7e0) AS avg_sleep_hours, coalesce(avg_spo2, 97e0) AS avg_spo2,
               coalesce(visit_count, 0) AS visit_count, coalesce(hospitalized_count, 0) AS hospitalized_count
        FROM or_snapshot)
SELECT employee_key, array_to_string({reasons_sql(SCORING_RULES)}, '; ') AS reasons FROM r""")
def q_validate_scoring(spark, sf):
    """ING11: snapshot rows as scoring requests: optional defaults, then the 16-field range rules."""
    s = snapshot(spark, sf).drop("chronic_count")
    v = I.validate_scoring_input(s)
    return v.select("employee_key", F.array_join("errors", "; ").alias("reasons"))


@register("ing12_validate_pricing", oracle=with_fixtures(["fx_companies"]) + """
SELECT company_id, array_to_string(list_filter([
  CASE WHEN base_premium IS NULL THEN 'base_premium: field required' END,
  CASE WHEN coalesce(base_premium <= 0, false) THEN 'base_premium: must be greater than 0' END,
  CASE WHEN coalesce(sum_assured_lakhs * 5 < 0 OR sum_assured_lakhs * 5 > 100, false) THEN 'hrs: must be between 0 and 100' END],
  lambda x: x IS NOT NULL), '; ') AS reasons
FROM fx_companies""")
def q_validate_pricing(spark, sf):
    """ING12: pricing requests per company (premium, with HRS = 5 x sum assured as the request value)."""
    c = fixture(spark, sf, "fx_companies").withColumn("hrs", F.col("sum_assured_lakhs") * 5)
    v = I.validate_pricing_input(c, "base_premium", "hrs")
    return v.select("company_id", F.array_join("errors", "; ").alias("reasons"))
