"""Domain tables derived from the driver's test tables.

These are *stand-in inputs only*: each fixture re-shapes a test table into the
schema an operator expects (an employee roster, telemetry, claims, lab lines,
...).  They do none of an operator's work.  Every expression here runs
unchanged in Spark SQL and DuckDB, so the same text feeds the Spark job (through
``spark.sql`` with DataFrame arguments) and the SQL oracle (as CTEs over the
pre-registered views).  ``{name}`` placeholders name a base table or another
fixture.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import BASE_TABLES, read_table

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["fx_employees"] = """
SELECT cast(c_custkey AS string) AS employee_key,
       concat('EMP_', lpad(cast(c_custkey AS string), 6, '0')) AS raw_id,
       concat('COMP_', lpad(cast(c_nationkey + 1 AS string), 3, '0')) AS company_id,
       cast(18 + (c_custkey * 31) % 53 AS int) AS age,
       CASE WHEN (c_custkey * 7) % 20 < 10 THEN 'M'
            WHEN (c_custkey * 7) % 20 < 19 THEN 'F' ELSE 'O' END AS gender,
       16e0 + (c_acctbal + 1000e0) * 26e0 / 11000e0 AS bmi,
       CASE WHEN (c_custkey * 13) % 100 < 22 THEN 1 ELSE 0 END AS smoker,
       CASE WHEN (c_custkey * 17) % 100 < 15 THEN 1 ELSE 0 END AS diabetic,
       CASE WHEN (c_custkey * 19) % 100 < 25 THEN 1 ELSE 0 END AS hypertension,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'manual'
            WHEN c_mktsegment = 'AUTOMOBILE' THEN 'field' ELSE 'desk' END AS job_category
FROM {customer}
"""

FIXTURE_SQL["fx_companies"] = """
SELECT concat('COMP_', lpad(cast(n.n_nationkey + 1 AS string), 3, '0')) AS company_id,
       n.n_name AS company_name,
       CASE n.n_nationkey % 6 WHEN 0 THEN 'Manufacturing' WHEN 1 THEN 'IT Services'
            WHEN 2 THEN 'Retail' WHEN 3 THEN 'Healthcare' WHEN 4 THEN 'Energy'
            ELSE 'Shipping' END AS industry,
       CASE n.n_regionkey WHEN 0 THEN 'North' WHEN 1 THEN 'South' WHEN 2 THEN 'East'
            WHEN 3 THEN 'West' ELSE 'Offshore' END AS region,
       cast(1 + (n.n_nationkey * 7) % 20 AS double) AS sum_assured_lakhs,
       cast(coalesce(k.cnt, 0) AS int) AS employee_count,
       coalesce(k.cnt, 0) * (60000e0 + n.n_nationkey * 2500e0) AS base_premium
FROM {nation} n
LEFT JOIN (SELECT c_nationkey, count(*) AS cnt FROM {customer} GROUP BY c_nationkey) k
  ON k.c_nationkey = n.n_nationkey
"""

FIXTURE_SQL["fx_telemetry"] = """
SELECT cast(user_id AS string) AS employee_key,
       event_id,
       ts,
       cast(1 + floor((day(ts) - 1) * 12 / 30e0) AS int) AS month_no,
       cast(floor(2000e0 + value * 120e0) AS int) AS avg_daily_steps,
       cast(50 + (event_id * 11) % 45 AS int) AS resting_hr,
       cast((event_id * 7) % 120 AS int) AS active_minutes,
       4e0 + ((event_id * 3) % 56) / 10e0 AS sleep_hours,
       92e0 + ((event_id * 5) % 80) / 10e0 AS spo2
FROM {events}
"""

FIXTURE_SQL["fx_clinical_events"] = """
SELECT concat('EVT_', lpad(cast(o_orderkey AS string), 9, '0')) AS event_id,
       cast(o_custkey AS string) AS employee_key,
       month(o_orderdate) AS month_no,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'cardiac' WHEN '2-HIGH' THEN 'injury'
            WHEN '3-MEDIUM' THEN 'diabetes' WHEN '4-NOT SPECIFIED' THEN 'general_visit'
            ELSE 'hypertension' END AS event_type,
       concat('I', cast(10 + o_orderkey % 80 AS string), '.', cast(o_orderkey % 10 AS string)) AS icd10_code,
       o_totalprice / 20e0 AS claim_amount,
       CASE WHEN o_totalprice / 20e0 > 15000 THEN 1 ELSE 0 END AS hospitalized
FROM {orders}
"""

FIXTURE_SQL["fx_lab_results"] = """
SELECT l.l_orderkey AS report_id,
       l.l_linenumber AS line_no,
       cast(o.o_custkey AS string) AS unique_id,
       CASE l.l_partkey % 14 WHEN 0 THEN 'Hb' WHEN 1 THEN 'HbA1c' WHEN 2 THEN 'ldl'
            WHEN 3 THEN 'SGPT' WHEN 4 THEN 'Creatinine' WHEN 5 THEN 'TSH' WHEN 6 THEN 'Calcium'
            WHEN 7 THEN 'Vit-B12' WHEN 8 THEN 'hs-CRP' WHEN 9 THEN 'Glucose' WHEN 10 THEN 'Vit D'
            WHEN 11 THEN 'Uric Acid' WHEN 12 THEN 'XYZ' ELSE 'HDL ' END AS marker_code,
       CASE WHEN l.l_returnflag = 'R' AND l.l_quantity >= 48 THEN 'OutOfRange'
            WHEN l.l_returnflag = 'N' THEN NULL ELSE 'normal' END AS status,
       CASE WHEN l.l_linestatus = 'O' AND l.l_discount >= 0.1 AND l.l_tax >= 0.08 THEN 'Medium'
            ELSE 'low' END AS risk_level,
       CASE WHEN o.o_custkey % 3 = 0 THEN 'female' WHEN o.o_custkey % 3 = 1 THEN 'Male' ELSE NULL END AS gender,
       l.l_shipdate AS report_date
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
"""

FIXTURE_SQL["fx_activity"] = """
SELECT p.p_partkey % cast(floor(k.n / 4e0) AS bigint) AS user_id,
       cast(2020 + floor(p.p_partkey / (k.n / 4e0)) AS int) AS year,
       CASE WHEN p.p_partkey % 11 = 0 THEN NULL WHEN p.p_partkey % 4 = 0 THEN 'outofrange' ELSE 'inrange' END AS heart_health,
       CASE WHEN p.p_partkey % 13 = 0 THEN NULL WHEN p.p_partkey % 5 = 0 THEN 'outofrange' ELSE 'inrange' END AS bone_health,
       CASE WHEN p.p_partkey % 17 = 0 THEN NULL WHEN p.p_partkey % 3 = 0 THEN 'outofrange' ELSE 'inrange' END AS diabetes,
       CASE WHEN p.p_partkey % 19 = 0 THEN NULL WHEN p.p_partkey % 6 = 0 THEN 'outofrange' ELSE 'inrange' END AS inflammation,
       CASE WHEN p.p_partkey % 23 = 0 THEN NULL WHEN p.p_partkey % 7 = 0 THEN 'outofrange' ELSE 'inrange' END AS iron,
       CASE WHEN p.p_partkey % 29 = 0 THEN NULL WHEN p.p_partkey % 8 = 0 THEN 'outofrange' ELSE 'inrange' END AS kidney_health,
       CASE WHEN p.p_partkey % 31 = 0 THEN NULL WHEN p.p_partkey % 9 = 0 THEN 'outofrange' ELSE 'inrange' END AS liver_health,
       CASE WHEN p.p_partkey % 37 = 0 THEN NULL WHEN p.p_partkey % 10 = 0 THEN 'outofrange' ELSE 'inrange' END AS thyroid_health,
       CASE WHEN p.p_partkey % 41 = 0 THEN NULL WHEN p.p_partkey % 2 = 0 THEN 'outofrange' ELSE 'inrange' END AS vitamin_deficiency,
       CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_retailprice * 2000e0 END AS step_count,
       cast(p.p_size * 300 AS double) AS steps_active_minutes,
       p.p_retailprice * 1500e0 AS distance_in_meters,
       cast((p.p_partkey * 7) % 5000 AS double) AS mindful_min,
       CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE p.p_size * 400e0 END AS total_active_minutes
FROM {part} p CROSS JOIN (SELECT count(*) AS n FROM {part}) k
"""

FIXTURE_SQL["fx_quotes"] = """
SELECT o.o_orderkey AS quote_id,
       c.c_mktsegment AS industry,
       r.r_name AS region,
       cast(1 + (o.o_custkey * 7) % 15 AS double) AS sum_assured_lakhs,
       o.o_totalprice / 10e0 AS estimated_annual_premium_per_employee_inr
FROM {orders} o
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""

FIXTURE_SQL["fx_underwriting"] = """
SELECT c_custkey AS row_key,
       cast(20 + (c_custkey * 29) % 45 AS int) AS applicant_age,
       CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CASE c_custkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Unknown' END AS occupation_risk,
       cast((c_custkey * 37) % 101 AS double) AS health_score,
       17e0 + ((c_custkey * 41) % 200) / 10e0 AS bmi,
       c_custkey % 5 = 0 AS smoker,
       cast((c_custkey * 11) % 7 AS int) AS previous_claims_count,
       cast(((c_custkey * 3) % 10) * 50000 AS bigint) AS coverage_amount,
       500e0 + (c_acctbal + 1000e0) / 2e0 AS premium_calculated
FROM {customer}
"""

FIXTURE_SQL["fx_charges"] = """
SELECT c_custkey AS row_key,
       cast(18 + (c_custkey * 23) % 47 AS int) AS age,
       17e0 + ((c_custkey * 41) % 250) / 10e0 AS bmi,
       cast((c_custkey * 3) % 6 AS int) AS children,
       CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN ' Female' WHEN 2 THEN 'F' ELSE 'x' END AS sex,
       CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN ' TRUE ' ELSE 'no' END AS smoker,
       CASE c_custkey % 5 WHEN 0 THEN 'southeast' WHEN 1 THEN 'Southwest' WHEN 2 THEN 'northeast'
            WHEN 3 THEN 'northwest' ELSE 'other' END AS region,
       c_acctbal * 3e0 AS prediction
FROM {customer}
"""

FIXTURE_SQL["fx_market"] = """
SELECT concat('EMP', lpad(cast(c_custkey AS string), 6, '0')) AS employee_id,
       cast(20 + (c_custkey * 31) % 45 AS double) AS age,
       CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE ' male' END AS gender,
       17e0 + ((c_custkey * 41) % 200) / 10e0 AS bmi,
       cast(100 + (c_custkey * 17) % 60 AS double) AS systolic_bp,
       cast(60 + (c_custkey * 13) % 40 AS double) AS diastolic_bp,
       cast((c_custkey * 7) % 100 AS double) AS diabetes_risk_score,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE cast(c_custkey % 5 AS double) END AS chronic_conditions,
       CASE WHEN c_custkey % 3 = 0 THEN 0e0 WHEN c_custkey % 11 = 0 THEN NULL
            ELSE (c_acctbal + 1000e0) * 12e0 END AS historical_claims_inr,
       cast(1500 + (c_custkey * 97) % 12000 AS double) AS avg_daily_steps,
       4e0 + ((c_custkey * 3) % 50) / 10e0 AS avg_sleep_hours,
       cast((c_custkey * 19) % 101 AS double) AS stress_score,
       CASE c_custkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Low' ELSE 'Other' END AS activity_level,
       cast((c_custkey * 53) % 101 AS double) AS wellness_engagement_score
FROM {customer}
"""

FIXTURE_SQL["fx_market_premium"] = """
SELECT concat('EMP', lpad(cast(c_custkey AS string), 6, '0')) AS employee_id,
       cast((c_custkey * 7) % 100 AS double) AS health_risk_score_weighted,
       CASE WHEN c_custkey % 50 = 1 THEN 0e0 ELSE 100000e0 + (c_custkey % 20) * 10000e0 END AS weight_based_premium_inr
FROM {customer}
WHERE c_custkey % 100 <> 0
"""

FIXTURE_SQL["fx_lab_reports"] = """
SELECT report_id, line_no,
       unique_id AS patient_name,
       CASE WHEN cast(unique_id AS bigint) % 2 = 0 THEN 'Female' ELSE 'male ' END AS sex,
       cast(22 + (cast(unique_id AS bigint) * 13) % 55 AS int) AS age,
       CASE marker_code WHEN 'Hb' THEN 'Hemoglobin' WHEN 'HbA1c' THEN 'HbA1c Glycated Hemoglobin'
            WHEN 'ldl' THEN 'LDL Cholesterol' WHEN 'SGPT' THEN 'SGPT / ALT'
            WHEN 'Creatinine' THEN 'Serum Creatinine' WHEN 'TSH' THEN 'Thyroid Stimulating Hormone'
            WHEN 'Calcium' THEN 'Calcium Total' WHEN 'Vit-B12' THEN 'Vitamin B12'
            WHEN 'hs-CRP' THEN 'C-Reactive Protein' WHEN 'Glucose' THEN 'Glucose Fasting'
            WHEN 'Vit D' THEN 'Vitamin D 25-OH' WHEN 'Uric Acid' THEN 'Uric Acid'
            ELSE marker_code END AS test_name,
       coalesce(status, '') = 'OutOfRange' AS abnormal
FROM {fx_lab_results}
"""

FIXTURE_SQL["fx_notes"] = """
SELECT doc_id AS note_id,
       concat('### Instruction: A ', cast(20 + doc_id % 75 AS string), '-year-old ',
              CASE WHEN doc_id % 2 = 0 THEN 'female' ELSE 'male' END,
              CASE WHEN doc_id % 3 = 0 THEN ' smoker' ELSE '' END,
              CASE WHEN doc_id % 4 = 0 THEN ' with type 2 diabetes' ELSE '' END,
              CASE WHEN doc_id % 5 = 0 THEN ' and hypertension' ELSE '' END,
              CASE WHEN doc_id % 7 = 0 THEN ' admitted to the ICU with sepsis' ELSE ' seen in clinic' END,
              CASE WHEN doc_id % 6 = 0 THEN '. BMI: 33.5' ELSE '' END,
              CASE WHEN doc_id % 8 = 0 THEN '. SpO2 91%' ELSE '' END,
              '. ', text, ' ### Response: none') AS text
FROM {documents}
"""

FIXTURE_SQL["fx_upload"] = """
SELECT concat('U', cast(c_custkey AS string)) AS emp_id,
       CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'F' WHEN 2 THEN 'x' ELSE NULL END AS sex,
       CASE WHEN c_custkey % 9 = 0 THEN 'n/a'
            ELSE concat(cast(15 + c_custkey % 30 AS string), '.', cast(c_custkey % 10 AS string)) END AS body_mass_index,
       CASE c_custkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' WHEN 3 THEN 'n/a'
            WHEN 4 THEN '2' ELSE 'No' END AS tobacco_use,
       CASE WHEN c_custkey % 97 = 0 THEN 'bad' WHEN c_custkey % 89 = 0 THEN '75'
            ELSE concat(cast(c_custkey % 3 AS string), '.', lpad(cast(c_custkey % 1000 AS string), 3, '0')) END AS lr,
       'blue' AS favourite_colour
FROM {customer}
"""

FIXTURE_SQL["fx_upload_clean"] = """
SELECT emp_id, sex, body_mass_index, tobacco_use,
       CASE WHEN lr IN ('bad', '75') THEN '1.000' ELSE lr END AS lr,
       favourite_colour
FROM {fx_upload}
"""

FIXTURE_SQL["fx_wearable_payload"] = """
SELECT event_id,
       concat('EMP_', lpad(cast(user_id + CASE WHEN event_id % 59 = 0 THEN 900000 ELSE 0 END AS string), 6, '0')) AS external_employee_id,
       CASE WHEN event_id % 29 = 0 THEN 'ACME'
            ELSE concat('COMP_', lpad(cast(user_id % 27 + 1 AS string), 3, '0')) END AS company_id,
       CASE WHEN event_id % 23 = 0 THEN 13 ELSE cast(1 + floor((day(ts) - 1) * 12 / 30e0) AS int) END AS month_no,
       CASE WHEN event_id % 17 = 0 THEN -5 WHEN event_id % 31 = 0 THEN 0
            ELSE cast(floor(value * 500e0) AS int) END AS steps,
       CASE WHEN event_id % 19 = 0 THEN 300 WHEN event_id % 37 = 0 THEN NULL
            ELSE cast(50 + (event_id * 11) % 45 AS int) END AS restingHR,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast((event_id * 7) % 120 AS int) END AS activeMinutes,
       CASE WHEN event_id % 41 = 0 THEN NULL ELSE 4e0 + ((event_id * 3) % 56) / 10e0 END AS sleepHours,
       CASE WHEN event_id % 43 = 0 THEN NULL ELSE 92e0 + ((event_id * 5) % 80) / 10e0 END AS SpO2,
       ts
FROM {events}
"""

FIXTURE_SQL["fx_clinical_payload"] = """
SELECT o_orderkey AS payload_id,
       concat('EMP_', lpad(cast(o_custkey + CASE WHEN o_orderkey % 59 = 0 THEN 900000 ELSE 0 END AS string), 6, '0')) AS external_employee_id,
       CASE WHEN o_orderkey % 41 = 0 THEN 'ACME'
            ELSE concat('COMP_', lpad(cast(o_custkey % 27 + 1 AS string), 3, '0')) END AS company_id,
       CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE month(o_orderdate) END AS month_no,
       CASE WHEN o_orderkey % 37 = 0 THEN 'dental'
            ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'cardiac' WHEN '2-HIGH' THEN 'injury'
                 WHEN '3-MEDIUM' THEN 'diabetes' WHEN '4-NOT SPECIFIED' THEN 'general_visit'
                 ELSE 'respiratory' END END AS event_type,
       CASE WHEN o_orderkey % 43 = 0 THEN ' e11.65-extra-long'
            ELSE concat(' i', cast(10 + o_orderkey % 80 AS string), '.', cast(o_orderkey % 10 AS string), ' ') END AS icd10_code,
       CASE WHEN o_orderkey % 47 = 0 THEN -1e0 ELSE o_totalprice / 20e0 END AS claim_amount,
       o_totalprice > 300000e0 AS hospitalized,
       o_orderdate AS ts
FROM {orders}
"""

FIXTURE_SQL["fx_principals"] = """
SELECT concat('user_', cast(s_suppkey AS string)) AS principal,
       CASE WHEN s_suppkey % 10 = 0 THEN 'underwriter' WHEN s_suppkey % 10 = 1 THEN 'viewer' ELSE 'hr_admin' END AS role,
       CASE WHEN s_suppkey % 10 > 2 THEN concat('COMP_', lpad(cast(s_nationkey + 1 AS string), 3, '0')) END AS company_id
FROM {supplier}
"""

FIXTURE_SQL["fx_access_requests"] = """
SELECT o_orderkey AS request_id,
       concat('user_', cast(o_custkey % (SELECT count(*) + 3 FROM {supplier}) AS string)) AS principal,
       CASE WHEN o_orderkey % 31 <> 0 THEN concat('COMP_', lpad(cast(o_orderkey % 25 + 1 AS string), 3, '0')) END AS company_id
FROM {orders}
"""

FIXTURE_SQL["fx_roster_payload"] = """
SELECT c_custkey AS row_no,
       concat('COMP_', lpad(cast(c_nationkey + 1 AS string), 3, '0')) AS company_id,
       concat('EMP_', lpad(cast(c_custkey % (SELECT cast(floor(count(*) * 0.8e0) AS bigint) FROM {customer}) AS string), 6, '0')) AS external_employee_id,
       cast(16 + (c_custkey * 31) % 58 AS int) AS age,
       CASE c_custkey % 7 WHEN 0 THEN 'X' WHEN 1 THEN 'F' WHEN 2 THEN 'O' ELSE 'M' END AS gender,
       8e0 + ((c_custkey * 41) % 560) / 10e0 AS bmi,
       c_custkey % 5 = 0 AS smoker,
       c_custkey % 7 = 0 AS diabetic,
       c_custkey % 4 = 0 AS hypertension,
       CASE c_custkey % 9 WHEN 0 THEN 'pilot' WHEN 1 THEN 'field' WHEN 2 THEN 'manual' ELSE 'desk' END AS job_category
FROM {customer}
"""

FIXTURE_SQL["fx_employees_b"] = """
SELECT employee_key, raw_id,
       CASE WHEN cast(employee_key AS bigint) % 97 = 0 THEN 'COMP_026' ELSE company_id END AS company_id,
       age, gender, bmi, smoker, diabetic, hypertension, job_category
FROM {fx_employees}
WHERE company_id <> 'COMP_025'
"""

_REF = re.compile(r"\{(\w+)\}")


def fixture_deps(name: str) -> list[str]:
    """Fixture names (not base tables) that ``name`` reads, in dependency order."""
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _REF.findall(FIXTURE_SQL[n]):
            if d in FIXTURE_SQL and d not in out:
                visit(d)
                out.append(d)

    visit(name)
    return out


_FIXTURES: dict = {}


def fixture(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """Build fixture ``name`` as a lazy Spark DataFrame over the Parquet tables (handle reused per session)."""
    gkey = (id(spark), sf_dir, name)
    hit = _FIXTURES.get(gkey)
    if hit is not None and hit.sparkSession is spark:
        return hit
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    args = {}
    for ref in set(_REF.findall(FIXTURE_SQL[name])):
        if ref in BASE_TABLES:
            args[ref] = cache.get(ref) or read_table(spark, sf_dir, ref)
            cache[ref] = args[ref]
        else:
            args[ref] = fixture(spark, sf_dir, ref, cache)
    df = spark.sql(FIXTURE_SQL[name], **args)
    cache[name] = df
    _FIXTURES[gkey] = df
    return df


def fixtures(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    cache: dict = {}
    return [fixture(spark, sf_dir, n, cache) for n in names]


def oracle_ctes(*names: str) -> str:
    """``WITH`` clause defining the fixtures (and their dependencies) for DuckDB."""
    order: list[str] = []
    for n in names:
        for d in fixture_deps(n) + [n]:
            if d not in order:
                order.append(d)
    parts = []
    for n in order:
        body = _REF.sub(lambda m: m.group(1), FIXTURE_SQL[n]).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    return "WITH " + ",\n".join(parts)
