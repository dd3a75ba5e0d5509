"""Registered queries: sources and sinks (SRC*, SNK*) and the streaming ingest jobs (STR*).

Round trips write into a fresh folder under the session's shared checkpoint
directory (``spark.checkpoint.dir``), never a machine-local temp folder.
"""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import DEFAULT_HASH_SALT
from ..functions.expr import pseudonymize
from ..operators import harmonize as H
from ..session import scratch_path
from ..sources import io as IO
from ..sources.fixtures import fixture
from ..sources.tables import BASE_TABLES, read_table
from ..streaming import ingest_streams as STR
from .catalog_core import snapshot
from .catalog_ingest import STREAMED_CLINICAL_SQL, STREAMED_WEARABLES_SQL, UPSERTED_SQL
from .catalog_harmonize import LAB_SNAPSHOT_CTES, UPLOAD_HEADERS, lab_snapshot, upload
from .catalog_mappers import _FEATS, _FLOATS_INT_COUNTS, _uw_sql
from .oracle_sql import CORE_FIXTURES, SNAPSHOT_CTES, with_fixtures
from .registry import register


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


_EMP_SCHEMA = T.StructType([
    T.StructField("employee_key", T.StringType()), T.StructField("raw_id", T.StringType()),
    T.StructField("company_id", T.StringType()), T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()), T.StructField("bmi", T.DoubleType()),
    T.StructField("smoker", T.IntegerType()), T.StructField("diabetic", T.IntegerType()),
    T.StructField("hypertension", T.IntegerType()), T.StructField("job_category", T.StringType())])


@register("src1_read_csv", oracle=with_fixtures(["fx_employees"]) + "\nSELECT * FROM fx_employees", floats=["bmi"])
def q_read_csv(spark, sf):
    """SRC1: the roster written as header CSV and read back with a declared schema (PERMISSIVE)."""
    path = _scratch(spark, "roster-csv")
    fixture(spark, sf, "fx_employees").write.option("header", True).csv(path)
    return IO.read_csv(spark, path, _EMP_SCHEMA)


@register("src2_read_upload", oracle=with_fixtures(["fx_upload"]) + "\nSELECT " + ", ".join(
    f'{c} AS "{h}"' for c, h in UPLOAD_HEADERS.items()) + " FROM fx_upload")
def q_read_upload(spark, sf):
    """SRC2: an upload CSV with customer headers read untyped (all strings, any column order)."""
    path = _scratch(spark, "upload-csv")
    upload(spark, sf).write.option("header", True).csv(path)
    return IO.read_upload(spark, path)


@register("src3_read_market", oracle=with_fixtures(["fx_market", "fx_market_premium"]) + """
SELECT e.employee_id, e.age, e.bmi, p.weight_based_premium_inr FROM fx_market e JOIN fx_market_premium p ON p.employee_id = e.employee_id""",
          floats=["age", "bmi", "weight_based_premium_inr"])
def q_read_market(spark, sf):
    """SRC3: the two market files landed as Parquet tables, read and joined."""
    a, b = _scratch(spark, "market-emp"), _scratch(spark, "market-prem")
    fixture(spark, sf, "fx_market").write.parquet(a)
    fixture(spark, sf, "fx_market_premium").select("employee_id", "weight_based_premium_inr").write.parquet(b)
    return IO.read_market(spark, a, b).select("employee_id", "age", "bmi", "weight_based_premium_inr")


@register("src4_read_snapshot", oracle=with_fixtures(["fx_underwriting"]) + _uw_sql()
          + "\nSELECT row_key, " + ", ".join(_FEATS) + " FROM m", floats=_FLOATS_INT_COUNTS)
def q_read_snapshot(spark, sf):
    """SRC4 (+MAP1, MAP2): a published snapshot read, its schema kind inferred and its mapper applied."""
    path = _scratch(spark, "snapshot")
    fixture(spark, sf, "fx_underwriting").write.parquet(path)
    kind, df = IO.read_snapshot(spark, path)
    return df.select("row_key", *_FEATS)


@register("src5_scan_snapshot", oracle=with_fixtures([*CORE_FIXTURES, "fx_lab_results"], SNAPSHOT_CTES, LAB_SNAPSHOT_CTES)
          + f"\nSELECT {', '.join(IO.SCORING_SCAN_COLUMNS)} FROM or_lab_snapshot WHERE company_id = 'COMP_003'",
          floats=["bmi", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins",
                  "avg_sleep_hours", "avg_spo2"])
def q_scan(spark, sf):
    """SRC5: the 25 scoring columns of one company's snapshot rows, lab flags included (predicate + projection)."""
    return IO.scan_snapshot(lab_snapshot(spark, sf), "COMP_003")


@register("src6_coerce_numeric", oracle=with_fixtures(["fx_upload", "fx_upload_clean"]) + """
SELECT emp_id, sex, body_mass_index, tobacco_use, CAST(lr AS DOUBLE) AS lr, favourite_colour FROM fx_upload_clean""",
          floats=["lr"])
def q_coerce(spark, sf):
    """SRC6: string columns that fully parse become numeric ('lr'); the rest stay strings."""
    return IO.coerce_numeric(fixture(spark, sf, "fx_upload_clean"))


_LANDED = ("fx_companies", "fx_employees", "fx_telemetry", "fx_clinical_events")


@register("snk1_append_tables", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + "\n" + " UNION ALL ".join(
    f"SELECT '{n[3:]}' AS \"table\", count(*) AS rows FROM {n}" for n in _LANDED)
    + " UNION ALL SELECT 'training_snapshots', count(*) FROM or_snapshot")
def q_append_tables(spark, sf):
    """SNK1: the five domain tables appended to a landing folder (an absent one skipped), then counted from storage."""
    root = _scratch(spark, "landing")
    tabs = {n[3:]: fixture(spark, sf, n) for n in _LANDED} | {"training_snapshots": snapshot(spark, sf), "missing": None}
    written = IO.append_tables(tabs, root)
    return IO.table_counts({n: spark.read.parquet(p) for n, p in written.items()})


@register("snk2_append_dataset", oracle=with_fixtures(list(CORE_FIXTURES) + ["fx_upload_clean"], SNAPSHOT_CTES) + """
SELECT (SELECT count(*) FROM or_snapshot) AS existing_rows, (SELECT count(*) FROM fx_upload_clean) AS new_rows,
       (SELECT count(*) FROM or_snapshot) + (SELECT count(*) FROM fx_upload_clean) AS total_rows, false AS dry_run""")
def q_append_dataset(spark, sf):
    """SNK2 (+HRM9/10): a harmonised upload appended to the training set as a new version, read back."""
    snap = snapshot(spark, sf).withColumnRenamed("employee_key", "employee_id")
    rows, _, _ = H.harmonize(upload(spark, sf, "fx_upload_clean"), snapshot(spark, sf))
    return IO.append_dataset(rows, snap, _scratch(spark, "training"), "1")


def _plain(df):
    """Decimals as doubles and shorts as integers, so that both engines compare the same types."""
    return df.select(*[F.col(f.name).cast("double" if isinstance(f.dataType, T.DecimalType) else
                                          "int" if isinstance(f.dataType, T.ShortType) else f.dataType).alias(f.name)
                       for f in df.schema.fields])


_SNAP_SCHEMA = IO.TABLE_SCHEMAS["training_snapshots"]
_SNAP_DEFAULTS = IO.TABLE_DEFAULTS["training_snapshots"]


def _snap_col(f):
    """DuckDB twin of a landed snapshot column: half-up to the column's scale."""
    if f.name in _SNAP_DEFAULTS:
        return f"{0 if isinstance(f.dataType, T.ShortType) else '0e0'} AS {f.name}"
    if isinstance(f.dataType, T.DecimalType):
        p, s = f.dataType.precision, f.dataType.scale
        return f"CAST(CAST(CAST(CAST({f.name} AS VARCHAR) AS DECIMAL(38,20)) AS DECIMAL({p},{s})) AS DOUBLE) AS {f.name}"
    return f"{'employee_key' if f.name == 'employee_id' else f.name} AS {f.name}"


@register("snk3_training_snapshots", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + "\nSELECT " + ", ".join(
    _snap_col(f) for f in _SNAP_SCHEMA.fields[1:-1]) + " FROM or_snapshot",
          floats=[f.name for f in _SNAP_SCHEMA.fields if isinstance(f.dataType, T.DecimalType)])
def q_training_snapshots(spark, sf):
    """SNK3: the training snapshot cast to its landed schema, lab columns at their defaults (row number and load time dropped)."""
    s = snapshot(spark, sf).withColumnRenamed("employee_key", "employee_id")
    return _plain(IO.apply_table_schema(s, "training_snapshots").drop("snapshot_id", "computed_at"))


@register("snk3_table_schema", oracle=with_fixtures(["fx_employees"]) + f"""
SELECT substr(sha256('{DEFAULT_HASH_SALT}' || raw_id), 1, 16) AS employee_id, company_id, age, gender,
       CAST(CAST(CAST(CAST(bmi AS VARCHAR) AS DECIMAL(38,20)) AS DECIMAL(4,1)) AS DOUBLE) AS bmi,
       CASE WHEN smoker = 1 THEN 1 ELSE 0 END AS smoker, 0 AS diabetic, 0 AS hypertension, job_category FROM fx_employees""",
          floats=["bmi"])
def q_table_schema(spark, sf):
    """SNK3: the roster cast to the landed employees schema with column defaults (load time dropped)."""
    e = fixture(spark, sf, "fx_employees").select(pseudonymize("raw_id", DEFAULT_HASH_SALT).alias("employee_id"),
                                                  "company_id", "age", "gender", "bmi", "job_category",
                                                  F.when(F.col("smoker") == 1, 1).alias("smoker"))
    return _plain(IO.apply_table_schema(e, "employees").drop("created_at"))


def _constraint_tables(spark, sf):
    comp = fixture(spark, sf, "fx_companies")
    emp = fixture(spark, sf, "fx_employees").withColumnRenamed("employee_key", "employee_id")
    clin = fixture(spark, sf, "fx_clinical_events").withColumnRenamed("employee_key", "employee_id")
    tele = fixture(spark, sf, "fx_telemetry").withColumnRenamed("employee_key", "employee_id")
    return {"companies": comp, "employees": emp, "telemetry": tele, "clinical_events": clin}


@register("snk4_constraint_report", oracle=with_fixtures(["fx_companies", "fx_employees", "fx_telemetry", "fx_clinical_events"]) + """
SELECT 'companies' AS "table", 'primary_key' AS "check", 'company_id' AS "column",
       CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT company_id, count(*) AS n FROM fx_companies GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'employees', 'primary_key', 'employee_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT employee_key, count(*) AS n FROM fx_employees GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'clinical_events', 'primary_key', 'event_id', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT event_id, count(*) AS n FROM fx_clinical_events GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'companies', 'not_null', 'company_id', count(*) FILTER (WHERE company_id IS NULL) FROM fx_companies
UNION ALL SELECT 'companies', 'not_null', 'company_name', count(*) FILTER (WHERE company_name IS NULL) FROM fx_companies
UNION ALL SELECT 'employees', 'not_null', 'employee_id', count(*) FILTER (WHERE employee_key IS NULL) FROM fx_employees
UNION ALL SELECT 'clinical_events', 'not_null', 'event_id', count(*) FILTER (WHERE event_id IS NULL) FROM fx_clinical_events
UNION ALL SELECT 'employees', 'foreign_key', 'company_id->companies.company_id', count(*) FROM fx_employees e WHERE company_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_companies c WHERE c.company_id = e.company_id)
UNION ALL SELECT 'telemetry', 'foreign_key', 'employee_id->employees.employee_id', count(*) FROM fx_telemetry x WHERE employee_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_employees e WHERE e.employee_key = x.employee_key)
UNION ALL SELECT 'clinical_events', 'foreign_key', 'employee_id->employees.employee_id', count(*) FROM fx_clinical_events x WHERE employee_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_employees e WHERE e.employee_key = x.employee_key)
UNION ALL SELECT 'companies', 'varchar_length', 'company_id', count(*) FILTER (WHERE length(company_id) > 20) FROM fx_companies
UNION ALL SELECT 'companies', 'varchar_length', 'company_name', count(*) FILTER (WHERE length(company_name) > 100) FROM fx_companies
UNION ALL SELECT 'companies', 'varchar_length', 'industry', count(*) FILTER (WHERE length(industry) > 50) FROM fx_companies
UNION ALL SELECT 'employees', 'varchar_length', 'employee_id', count(*) FILTER (WHERE length(employee_key) > 64) FROM fx_employees
UNION ALL SELECT 'employees', 'varchar_length', 'company_id', count(*) FILTER (WHERE length(company_id) > 20) FROM fx_employees
UNION ALL SELECT 'employees', 'varchar_length', 'gender', count(*) FILTER (WHERE length(gender) > 1) FROM fx_employees
UNION ALL SELECT 'employees', 'varchar_length', 'job_category', count(*) FILTER (WHERE length(job_category) > 20) FROM fx_employees
UNION ALL SELECT 'clinical_events', 'varchar_length', 'event_id', count(*) FILTER (WHERE length(event_id) > 64) FROM fx_clinical_events
UNION ALL SELECT 'clinical_events', 'varchar_length', 'event_type', count(*) FILTER (WHERE length(event_type) > 50) FROM fx_clinical_events
UNION ALL SELECT 'clinical_events', 'varchar_length', 'icd10_code', count(*) FILTER (WHERE length(icd10_code) > 10) FROM fx_clinical_events""")
def q_constraints(spark, sf):
    """SNK4: constraint audit of the landed tables (PK, NOT NULL, FK, VARCHAR length)."""
    return IO.constraint_report(_constraint_tables(spark, sf))


@register("snk5_table_counts", oracle="\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in BASE_TABLES))
def q_counts(spark, sf):
    """SNK5: row count of every base table."""
    return IO.table_counts({t: read_table(spark, sf, t) for t in BASE_TABLES})


# ---- streaming ---------------------------------------------------------------------------------

def _land(spark, df, name, parts: int = 4):
    """Write a payload table as several files so the stream sees a multi-file source."""
    path = _scratch(spark, name)
    df.repartition(parts).write.parquet(path)
    return path, df.schema


def _employees_pseudo(spark, sf):
    return fixture(spark, sf, "fx_employees").select(pseudonymize("raw_id", DEFAULT_HASH_SALT).alias("employee_id"),
                                                     "company_id", "age", "gender", "bmi", "smoker", "diabetic",
                                                     "hypertension", "job_category")


@register("str1_stream_wearables", oracle=STREAMED_WEARABLES_SQL, floats=["sleep_hours", "spo2"])
def q_stream_wearables(spark, sf):
    """STR1: wearable payloads streamed (availableNow) through validate -> normalise -> checks -> sink."""
    src, schema = _land(spark, fixture(spark, sf, "fx_wearable_payload"), "wearable-src")
    out, dl, ck = _scratch(spark, "telemetry"), _scratch(spark, "telemetry-dl"), _scratch(spark, "telemetry-ck")
    STR.stream_wearables(spark, src, schema, fixture(spark, sf, "fx_companies"), _employees_pseudo(spark, sf), out, dl, ck)
    return spark.read.parquet(out).drop("batch_id")


@register("str2_stream_clinical", oracle=STREAMED_CLINICAL_SQL, floats=["claim_amount"])
def q_stream_clinical(spark, sf):
    """STR2: clinical payloads streamed with idempotent event ids, deduplicated by keyed state on disk."""
    src, schema = _land(spark, fixture(spark, sf, "fx_clinical_payload"), "clinical-src")
    out, dl, ck = _scratch(spark, "events"), _scratch(spark, "events-dl"), _scratch(spark, "events-ck")
    STR.stream_clinical(spark, src, schema, fixture(spark, sf, "fx_companies"), _employees_pseudo(spark, sf), out, dl, ck)
    return spark.read.parquet(out).drop("stream", "batch_id")


@register("str3_stream_roster", oracle=UPSERTED_SQL, floats=["bmi"])
def q_stream_roster(spark, sf):
    """STR3: roster payloads streamed as upserts; the latest roster version."""
    src, schema = _land(spark, fixture(spark, sf, "fx_roster_payload"), "roster-src")
    out, dl, ck = _scratch(spark, "roster"), _scratch(spark, "roster-dl"), _scratch(spark, "roster-ck")
    STR.stream_roster(spark, src, schema, _employees_pseudo(spark, sf), out, dl, ck)
    return STR.latest_roster(spark, out)


@register("ing16_append_events", oracle=with_fixtures(["fx_wearable_payload", "fx_employees", "fx_companies"]) + """
SELECT count(*) AS rows FROM fx_wearable_payload
WHERE NOT (company_id IS NULL OR external_employee_id IS NULL OR month_no IS NULL
           OR NOT regexp_matches(company_id, '^COMP_\\d{3}$') OR month_no < 1 OR month_no > 12
           OR coalesce(steps < 0 OR steps > 100000, false) OR coalesce(restingHR < 30 OR restingHR > 220, false))""")
def q_append_events(spark, sf):
    """ING16 (+ING3, ING7): normalised telemetry appended in two batches, then counted from storage."""
    from .catalog_ingest import wearable_normalized
    from ..operators import ingest as I
    path = _scratch(spark, "telemetry-append")
    wn = wearable_normalized(spark, sf)
    I.append_events(wn.where(F.col("month_no") <= 6), path)
    I.append_events(wn.where(F.col("month_no") > 6), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
