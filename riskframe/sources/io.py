"""Sources and sinks (SRC1-SRC6, SNK1-SNK5)."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import LAB_FLAGS

# ---- SRC -------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC1: header CSV with a declared schema; malformed values become null (PERMISSIVE)."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: an untyped upload: any columns, any order, every value a string (no inference)."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_market(spark: SparkSession, employees_path: str, premiums_path: str, fmt: str = "parquet") -> DataFrame:
    """SRC3: the two market files (landed as tables) joined on employee id (MAP5)."""
    from ..operators.mappers import join_market
    e = spark.read.format(fmt).option("header", True).load(employees_path)
    p = spark.read.format(fmt).option("header", True).load(premiums_path)
    return join_market(e, p)


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet", key: str | None = None) -> tuple[str, DataFrame]:
    """SRC4: read a published dataset snapshot, infer its schema kind and dispatch the mapper."""
    from ..operators import mappers as M
    from ..operators import notes as N
    df = spark.read.format(fmt).load(path)
    kind = M.infer_schema_kind(df)
    if kind == "underwriting_tabular":
        return kind, M.map_underwriting(df, key or "row_key")
    if kind == "insurance_charges":
        return kind, M.map_charges(df, key or "row_key")
    if kind == "company_profiles":
        raise M.UnsupportedSchema("company profile metadata has no employee health or claim targets; "
                                  "it cannot train the underwriting model")
    return kind, N.map_notes(N.parse_notes(df), key or "note_id")


# The 25 snapshot columns read for company scoring.
SCORING_SCAN_COLUMNS = [
    "age", "gender", "bmi", "smoker", "diabetic", "hypertension", "chronic_count",
    "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend",
    "avg_active_mins", "avg_sleep_hours", "avg_spo2", "visit_count", "hospitalized_count",
    "lab_heart_flag", "lab_inflammation_flag", "lab_diabetes_flag", "lab_kidney_flag", "lab_liver_flag",
    "lab_iron_flag", "lab_thyroid_flag", "lab_bone_flag", "lab_vitamin_flag",
]


def scan_snapshot(snapshot: DataFrame, company_id: str, columns=SCORING_SCAN_COLUMNS) -> DataFrame:
    """SRC5: projection of the scoring columns with a ``company_id = ?`` predicate.

    Over a Parquet table both reach the scan (ReadSchema / PushedFilters);
    columns the snapshot lacks are skipped.
    """
    present = [c for c in columns if c in snapshot.columns]
    return snapshot.where(F.col("company_id") == F.lit(company_id)).select(*present)


def coerce_numeric(df: DataFrame) -> DataFrame:
    """SRC6: string columns whose every non-null value parses as a number become DOUBLE; others stay.

    One aggregate counts unparseable values per string column; the per-column
    type decision is schema work on that one row.
    """
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return df
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c)
                   for c in strs]).first()
    convert = {c for c in strs if bad[c] == 0}
    return df.select(*[(F.col(f"`{c}`").try_cast("double") if c in convert else F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


# ---- SNK -------------------------------------------------------------------------------------

def append_tables(tables: dict, root: str, fmt: str = "parquet") -> dict:
    """SNK1: append each present table to ``root/<name>``; absent (None) tables are skipped."""
    written = {}
    for name, df in tables.items():
        if df is None:
            continue
        df.write.mode("append").format(fmt).save(os.path.join(root, name))
        written[name] = os.path.join(root, name)
    return written


def append_dataset(new: DataFrame, existing: DataFrame, root: str, name: str, dry_run: bool = False) -> DataFrame:
    """SNK2: align the new rows to the existing columns and append them as one version of the table at ``root``.

    The table starts with ``existing`` (its first version, which stays readable as the backup); an append writes
    only its own rows, and appending the same ``name`` again changes nothing.  Returns the row counts of the
    table before, of the new rows and of the table after, the last one read back; a dry run only counts.
    """
    from ..operators.harmonize import align_rows
    from .versions import VersionedTable
    table = VersionedTable(existing.sparkSession, root)

    def rows(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    report = rows(existing, "existing_rows").crossJoin(rows(new, "new_rows"))
    if dry_run:
        return report.withColumn("total_rows", F.col("existing_rows") + F.col("new_rows")).withColumn("dry_run", F.lit(True))
    table.commit(existing, "existing")
    version = table.commit(align_rows(existing, new), f"append-{name}")
    return report.crossJoin(rows(table.read(version), "total_rows")).withColumn("dry_run", F.lit(False))


# Landed table schemas, defaults and constraints.
TABLE_SCHEMAS = {
    "companies": T.StructType([
        T.StructField("company_id", T.StringType(), False), T.StructField("company_name", T.StringType(), False),
        T.StructField("industry", T.StringType()), T.StructField("city", T.StringType()),
        T.StructField("employee_count", T.IntegerType()), T.StructField("risk_profile", T.DecimalType(4, 3)),
        T.StructField("base_premium", T.LongType()), T.StructField("created_at", T.TimestampType())]),
    "employees": T.StructType([
        T.StructField("employee_id", T.StringType(), False), T.StructField("company_id", T.StringType()),
        T.StructField("age", T.ShortType()), T.StructField("gender", T.StringType()),
        T.StructField("bmi", T.DecimalType(4, 1)), T.StructField("smoker", T.ShortType()),
        T.StructField("diabetic", T.ShortType()), T.StructField("hypertension", T.ShortType()),
        T.StructField("job_category", T.StringType()), T.StructField("created_at", T.TimestampType())]),
    "telemetry": T.StructType([
        T.StructField("id", T.LongType()), T.StructField("employee_id", T.StringType()),
        T.StructField("company_id", T.StringType()), T.StructField("month", T.ShortType()),
        T.StructField("avg_daily_steps", T.IntegerType()), T.StructField("resting_hr", T.ShortType()),
        T.StructField("active_minutes", T.ShortType()), T.StructField("sleep_hours", T.DecimalType(3, 1)),
        T.StructField("spo2", T.DecimalType(4, 1)), T.StructField("created_at", T.TimestampType())]),
    "clinical_events": T.StructType([
        T.StructField("event_id", T.StringType(), False), T.StructField("employee_id", T.StringType()),
        T.StructField("company_id", T.StringType()), T.StructField("month", T.ShortType()),
        T.StructField("event_type", T.StringType()), T.StructField("icd10_code", T.StringType()),
        T.StructField("claim_amount", T.DecimalType(12, 2)), T.StructField("hospitalized", T.ShortType()),
        T.StructField("created_at", T.TimestampType())]),
}
TABLE_SCHEMAS["training_snapshots"] = T.StructType(
    [T.StructField("snapshot_id", T.LongType())] + [T.StructField(n, t) for n, t in (
        ("employee_id", T.StringType()), ("company_id", T.StringType()), ("age", T.ShortType()), ("gender", T.StringType()),
        ("bmi", T.DecimalType(4, 1)), ("smoker", T.ShortType()), ("diabetic", T.ShortType()), ("hypertension", T.ShortType()),
        ("job_category", T.StringType()), ("avg_daily_steps", T.DecimalType(10, 2)), ("step_volatility", T.DecimalType(10, 2)),
        ("avg_resting_hr", T.DecimalType(5, 1)), ("hr_trend", T.DecimalType(10, 4)), ("avg_active_mins", T.DecimalType(5, 1)),
        ("avg_sleep_hours", T.DecimalType(4, 1)), ("avg_spo2", T.DecimalType(4, 1)), ("total_claims", T.DecimalType(12, 2)),
        ("visit_count", T.DecimalType(8, 1)), ("hospitalized_count", T.DecimalType(8, 1)), ("premium_share", T.DecimalType(12, 2)),
        ("loss_ratio", T.DecimalType(8, 4)), ("high_risk", T.ShortType()), ("chronic_count", T.ShortType()))]
    + [T.StructField(f, T.ShortType()) for f in (*LAB_FLAGS, "lab_domain_count")]
    + [T.StructField("lab_risk_score", T.DecimalType(5, 3)), T.StructField("computed_at", T.TimestampType())])
TABLE_DEFAULTS = {"training_snapshots": dict.fromkeys((*LAB_FLAGS, "lab_domain_count", "lab_risk_score"), 0),
                  "employees": {"smoker": 0, "diabetic": 0, "hypertension": 0},
                  "clinical_events": {"hospitalized": 0}}
# Keys of the tables whose rows bring their own; the store numbers telemetry and snapshot rows.
PRIMARY_KEYS = {"companies": ["company_id"], "employees": ["employee_id"], "clinical_events": ["event_id"]}
FOREIGN_KEYS = [("employees", "company_id", "companies", "company_id"),
                ("telemetry", "employee_id", "employees", "employee_id"),
                ("clinical_events", "employee_id", "employees", "employee_id")]
VARCHAR_LIMITS = {"companies": {"company_id": 20, "company_name": 100, "industry": 50, "city": 50},
                  "employees": {"employee_id": 64, "company_id": 20, "gender": 1, "job_category": 20},
                  "clinical_events": {"event_id": 64, "event_type": 50, "icd10_code": 10},
                  "training_snapshots": {"employee_id": 16, "company_id": 20, "gender": 1, "job_category": 20}}


def apply_table_schema(df: DataFrame, table: str) -> DataFrame:
    """SNK3: cast to the landed schema, fill column defaults (0 flags, ``now()`` load time)."""
    schema = TABLE_SCHEMAS[table]
    defaults = TABLE_DEFAULTS.get(table, {})
    cols = []
    for f in schema.fields:
        src = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            src = F.coalesce(src, F.lit(defaults[f.name]))
        if f.name in ("created_at", "computed_at"):
            src = F.coalesce(src, F.current_timestamp())
        cols.append(src.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def constraint_report(tables: dict) -> DataFrame:
    """SNK4: PK duplicates, NOT NULL violations, FK orphans (anti joins) and VARCHAR overflows, as rows.

    The row-wise checks of a table are one aggregate, so one scan; each key takes a scan of its column."""
    parts = []

    def report(t: str, counts: DataFrame, checks: list) -> None:
        rows = [F.struct(F.lit(t).alias("table"), F.lit(check).alias("check"), F.lit(column).alias("column"),
                         F.coalesce(F.col(f"_v{i}"), F.lit(0)).cast("long").alias("violations"))
                for i, (check, column) in enumerate(checks)]
        parts.append(counts.select(F.inline(F.array(*rows))))

    for t, keys in PRIMARY_KEYS.items():
        if t in tables:
            d = tables[t].groupBy(*keys).count().where("count > 1")
            report(t, d.agg(F.sum(F.col("count") - 1).alias("_v0")), [("primary_key", ",".join(keys))])
    for t, schema in TABLE_SCHEMAS.items():
        if t in tables:
            has = set(tables[t].columns)
            checks = {("not_null", f.name): F.col(f.name).isNull() for f in schema.fields
                      if not f.nullable and f.name in has}
            checks |= {("varchar_length", c): F.length(c) > n for c, n in VARCHAR_LIMITS.get(t, {}).items() if c in has}
            if checks:
                report(t, tables[t].agg(*[F.count_if(e).alias(f"_v{i}") for i, e in enumerate(checks.values())]),
                       list(checks))
    for t, c, rt, rc in FOREIGN_KEYS:
        if t in tables and rt in tables:
            o = tables[t].where(F.col(c).isNotNull()).join(tables[rt].select(F.col(rc).alias(c)), c, "left_anti")
            report(t, o.agg(F.count(F.lit(1)).alias("_v0")), [("foreign_key", f"{c}->{rt}.{rc}")])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_counts(tables: dict) -> DataFrame:
    """SNK5: row count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
