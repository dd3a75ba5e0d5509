"""Row normalisation, validation and ingestion (ING1-ING19).

Validation never raises: every rule becomes a ``when(rule_fails, reason)``
element of an ``errors`` array, so one pass splits a batch (or a micro-batch
of a stream) into valid rows and rejected rows with all their reasons.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (COMPANY_ID_PATTERN, DEFAULT_HASH_SALT, EVENT_TYPES, VALID_GENDER,
                                   VALID_JOB, WEARABLE_ALIASES, WEARABLE_RULES)
from ..functions.expr import clamp, pseudonymize, round_even


def _errors(*rules) -> F.Column:
    """``rules`` are (failing-condition, reason); nulls in a condition count as passing."""
    arr = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(reason)) for cond, reason in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def split_valid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows without the errors column, rejected rows with their reasons)."""
    return df.where(F.size(errors) == 0).drop(errors), df.where(F.size(errors) > 0)


def _required(*cols):
    return [(F.col(c).isNull(), f"{c}: field required") for c in cols]


# ---- ING13: payload aliases --------------------------------------------------------------

def resolve_payload_aliases(df: DataFrame, aliases: dict = WEARABLE_ALIASES) -> DataFrame:
    """ING13: accept either the canonical field or its alias (canonical wins when both exist)."""
    lower = {c.lower(): c for c in df.columns}
    out = df
    for canon, alias in aliases.items():
        c, a = lower.get(canon.lower()), lower.get(alias.lower())
        if c and a and c != a:
            out = out.withColumn(canon, F.coalesce(F.col(c), F.col(a))).drop(a)
        elif a and not c:
            out = out.withColumnRenamed(a, canon)
        elif not c:
            out = out.withColumn(canon, F.lit(None).cast("double"))
    return out


# ---- ING7-ING12: validation ---------------------------------------------------------------

def validate_wearable(df: DataFrame) -> DataFrame:
    """ING7: company id pattern, month 1..12, steps 0..100000, resting HR 30..220 (nulls allowed).

    Runs on raw payloads, before normalisation (ING3).
    """
    return df.withColumn("errors", _errors(
        *_required("external_employee_id", "company_id", "month_no"),
        (~F.col("company_id").rlike(COMPANY_ID_PATTERN), "company_id: must match ^COMP_\\d{3}$"),
        ((F.col("month_no") < 1) | (F.col("month_no") > 12), "month: must be between 1 and 12"),
        ((F.col("daily_steps") < 0) | (F.col("daily_steps") > 100000), "daily_steps: step count out of sensor range"),
        ((F.col("heart_rate_rest") < 30) | (F.col("heart_rate_rest") > 220),
         "heart_rate_rest: heart rate out of physiological range"),
    ))


def validate_clinical(df: DataFrame) -> DataFrame:
    """ING8: event type in six literals, ICD-10 at most 10 chars, amount 0..5,000,000, month, company."""
    return df.withColumn("errors", _errors(
        *_required("external_employee_id", "company_id", "month_no", "event_type", "icd10_code", "claim_amount"),
        (~F.col("company_id").rlike(COMPANY_ID_PATTERN), "company_id: must match ^COMP_\\d{3}$"),
        (~F.col("event_type").isin(*EVENT_TYPES), "event_type: not a known event type"),
        (F.length("icd10_code") > 10, "icd10_code: at most 10 characters"),
        ((F.col("claim_amount") < 0) | (F.col("claim_amount") > 5_000_000), "claim_amount: must be 0..5000000"),
        ((F.col("month_no") < 1) | (F.col("month_no") > 12), "month: must be between 1 and 12"),
    ))


def validate_employee(df: DataFrame) -> DataFrame:
    """ING9: age 18..70, gender M/F/O, bmi 10..60, job desk/field/manual."""
    return df.withColumn("errors", _errors(
        *_required("external_employee_id", "age", "gender", "bmi", "job_category"),
        ((F.col("age") < 18) | (F.col("age") > 70), "age: must be between 18 and 70"),
        (~F.col("gender").isin(*VALID_GENDER), "gender: must be one of M, F, O"),
        ((F.col("bmi") < 10) | (F.col("bmi") > 60), "bmi: must be between 10 and 60"),
        (~F.col("job_category").isin(*VALID_JOB), "job_category: must be one of desk, field, manual"),
    ))


def validate_batch_size(df: DataFrame, batch: str = "company_id", lo: int = 1, hi: int = 1000) -> DataFrame:
    """ING10: a roster batch must hold 1..1000 members (partial+final count per batch)."""
    c = df.groupBy(batch).agg(F.count(F.lit(1)).alias("members"))
    return c.withColumn("valid", (F.col("members") >= lo) & (F.col("members") <= hi))


# Scoring-request ranges (field, lo, hi, lo_exclusive) and defaults for optional fields.
SCORING_RANGES = [
    ("age", 18, 70), ("bmi", 10, 60), ("avg_daily_steps", 0, 30000), ("step_volatility", 0, None),
    ("avg_resting_hr", 40, 120), ("avg_active_mins", 0, 240), ("avg_sleep_hours", 3, 12),
    ("avg_spo2", 85, 100), ("visit_count", 0, None), ("hospitalized_count", 0, None),
]
SCORING_DEFAULTS = {"smoker": 0, "diabetic": 0, "hypertension": 0, "step_volatility": 0.0, "hr_trend": 0.0,
                    "avg_active_mins": 30.0, "avg_sleep_hours": 7.0, "avg_spo2": 97.0, "visit_count": 0,
                    "hospitalized_count": 0}


def validate_scoring_input(df: DataFrame) -> DataFrame:
    """ING11: defaults for the optional fields, then range rules for 16 request fields."""
    out = df
    for c, v in SCORING_DEFAULTS.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in out.columns else out.withColumn(c, F.lit(v))
    rules = _required("age", "gender", "bmi", "avg_daily_steps", "avg_resting_hr")
    rules.append((~F.col("gender").isin(*VALID_GENDER), "gender: must be one of M, F, O"))
    for c, lo, hi in SCORING_RANGES:
        cond = F.col(c) < lo
        if hi is not None:
            cond = cond | (F.col(c) > hi)
        rules.append((cond, f"{c}: must be between {lo} and {hi}" if hi is not None else f"{c}: must be >= {lo}"))
    out = out.withColumn("chronic_count", F.coalesce(F.col("chronic_count"),
                                                     (F.col("diabetic").cast("int") + F.col("hypertension").cast("int")))) \
        if "chronic_count" in out.columns else out.withColumn(
            "chronic_count", F.col("diabetic").cast("int") + F.col("hypertension").cast("int"))
    return out.withColumn("errors", _errors(*rules))


def validate_pricing_input(df: DataFrame, premium: str = "base_premium", hrs: str = "hrs",
                           projected: str | None = None) -> DataFrame:
    """ING12: premium > 0 and HRS within 0..100 (also the projected HRS for ROI requests)."""
    rules = _required(premium, hrs) + [
        (F.col(premium) <= 0, f"{premium}: must be greater than 0"),
        ((F.col(hrs) < 0) | (F.col(hrs) > 100), f"{hrs}: must be between 0 and 100")]
    if projected:
        rules.append(((F.col(projected) < 0) | (F.col(projected) > 100), f"{projected}: must be between 0 and 100"))
    return df.withColumn("errors", _errors(*rules))


# ---- ING3-ING6: normalisation ---------------------------------------------------------------

def normalize_wearable(df: DataFrame, salt: str = DEFAULT_HASH_SALT, keep=()) -> DataFrame:
    """ING3/ING6: missing **or zero** -> default, clamp, sleep/SpO2 to 1 dp; pseudonymised id."""
    cols = [*keep, pseudonymize("external_employee_id", salt).alias("employee_id"), F.col("company_id"),
            F.col("month_no").cast("int").alias("month_no")]
    for out, field, default, lo, hi, dec in WEARABLE_RULES:
        v = F.coalesce(F.when(F.col(field) != 0, F.col(field)), F.lit(default))
        v = clamp(v.cast("double") if dec is not None else v.cast("int"), lo, hi)
        cols.append((round_even(v, dec) if dec is not None else v.cast("int")).alias(out))
    return df.select(*cols)


def normalize_clinical(df: DataFrame, salt: str = DEFAULT_HASH_SALT, keep=()) -> DataFrame:
    """ING4: ICD upper+trim, amount 2 dp, hospitalised 0/1, idempotent event id.

    The event id is a hash of the natural key, so replaying the same payload
    produces the same id (the reference draws a random one).
    """
    nat = F.concat_ws("|", "external_employee_id", "company_id", F.col("month_no").cast("string"), "event_type",
                      "icd10_code", F.col("claim_amount").cast("string"))
    return df.select(
        *keep,
        F.concat(F.lit("EVT_"), F.upper(F.substring(F.sha2(nat, 256), 1, 16))).alias("event_id"),
        pseudonymize("external_employee_id", salt).alias("employee_id"),
        "company_id", F.col("month_no").cast("int").alias("month_no"), "event_type",
        F.upper(F.trim("icd10_code")).alias("icd10_code"),
        round_even(F.col("claim_amount").cast("double"), 2).alias("claim_amount"),
        F.coalesce(F.col("hospitalized").cast("boolean").cast("int"), F.lit(0)).alias("hospitalized"))


def normalize_employee(df: DataFrame, salt: str = DEFAULT_HASH_SALT, keep=()) -> DataFrame:
    """ING5: age clamp 18..70 (int), bmi clamp 10..60 (1 dp), booleans -> 0/1."""
    b = lambda c: F.coalesce(F.col(c).cast("boolean").cast("int"), F.lit(0)).alias(c)
    return df.select(*keep,
        pseudonymize("external_employee_id", salt).alias("employee_id"), "company_id",
        clamp(F.col("age"), 18, 70).cast("int").alias("age"), "gender",
        round_even(clamp(F.col("bmi").cast("double"), 10.0, 60.0), 1).alias("bmi"),
        b("smoker"), b("diabetic"), b("hypertension"), "job_category")


# ---- ING14-ING18: referential checks, append, upsert, receipt ---------------------------------

def require_company(df: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ING14: (rows whose company exists, rows with an unknown company) via semi / anti joins."""
    keys = companies.select("company_id")
    return df.join(keys, "company_id", "left_semi"), df.join(keys, "company_id", "left_anti")


def require_employee(df: DataFrame, employees: DataFrame, key: str = "employee_id") -> tuple[DataFrame, DataFrame]:
    """ING15: (rows whose employee exists, rows with an unknown employee) via semi / anti joins."""
    keys = employees.select(key)
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def append_events(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """ING16: append rows to the events table (distributed writers, no rewrite of old files)."""
    df.write.mode("append").format(fmt).save(path)


UPSERT_UPDATABLE = ["age", "bmi", "smoker", "diabetic", "hypertension", "job_category"]


def upsert_roster(target: DataFrame, batch: DataFrame, key: str = "employee_id",
                  order: str = "row_no") -> DataFrame:
    """ING17: insert new people; for existing keys update age, bmi, the three conditions and job.

    ``gender`` and ``company_id`` are never updated.  Within a batch the last row
    per key (by ``order``, ties by the row's values) wins: one partial + final ``max`` per key, so a
    key with very many rows needs no sort.  Implemented as a full outer join on the key
    with per-column coalesce (MERGE is not available on Parquet tables).
    """
    rest = [c for c in batch.columns if c not in (key, order)]
    last = batch.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_last")).select(key, *[f"_last.{c}" for c in rest])
    t, b = target.alias("t"), last.alias("b")
    j = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    cols = [F.coalesce(F.col(f"t.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in target.columns:
        if c == key:
            continue
        if c in UPSERT_UPDATABLE:
            cols.append(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")).alias(c))
    return j.select(*cols)


def ingest_receipt(valid: DataFrame, rejected: DataFrame, batch: str = "company_id") -> DataFrame:
    """ING18: per batch: rows received, stored and rejected, status success/partial.

    The error lines are rows of their own (:func:`receipt_errors`), so no task holds a batch's list.
    """
    v = valid.groupBy(batch).agg(F.count(F.lit(1)).alias("records_stored"))
    r = rejected.groupBy(batch).agg(F.count(F.lit(1)).alias("_rejected"))
    stored, errors = F.coalesce("records_stored", F.lit(0)), F.coalesce("_rejected", F.lit(0))
    return v.join(r, batch, "full_outer").select(
        batch, (stored + errors).alias("records_received"), stored.alias("records_stored"), errors.alias("n_errors"),
        F.when(errors == 0, "success").otherwise("partial").alias("status"))


def receipt_errors(rejected: DataFrame, batch: str = "company_id", row: str = "row_no") -> DataFrame:
    """ING18: the receipt's error lines, one row per rejected row: ``row_<n>: <reason>; <reason>``."""
    return rejected.select(batch, row, F.concat(F.lit("row_"), F.col(row).cast("string"), F.lit(": "),
                                                F.array_join("errors", "; ")).alias("error"))
