"""Per-person rollups and the training snapshot (AGG1-AGG15).

All rollups are ``groupBy`` aggregations, so Spark runs them as partial
(map-side) + final hash aggregates: only one row per key and map task crosses
the shuffle, whatever the skew of the key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import LAB_FLAGS, LAB_WEIGHTS
from ..functions.expr import clamp, round_even
from ..functions.ranks import range_partitions


def rollup_telemetry(telemetry: DataFrame, key: str = "employee_key") -> DataFrame:
    """AGG1: mean steps/HR/active/sleep/SpO2 and sample std-dev of steps per person."""
    return telemetry.groupBy(key).agg(
        F.avg("avg_daily_steps").alias("avg_daily_steps"),
        F.stddev_samp("avg_daily_steps").alias("step_volatility"),
        F.avg("resting_hr").alias("avg_resting_hr"),
        F.avg("active_minutes").alias("avg_active_mins"),
        F.avg("sleep_hours").alias("avg_sleep_hours"),
        F.avg("spo2").alias("avg_spo2"),
    )


def _segments(telemetry: DataFrame, key: str, order, extra=(), partitions: int | None = None) -> DataFrame:
    """Telemetry summed per (range partition, person): one row per person, more only where a person
    spans partitions.  ``_n, _mx, _my, _c, _v`` are the count, the mean position, the mean heart rate
    and their centred sums over the readings that have a heart rate; ``_mx`` counts positions from the
    person's first row."""
    p = partitions or range_partitions(telemetry)
    y = F.col("resting_hr").cast("double")
    t = (telemetry.repartitionByRange(p, key, *order).sortWithinPartitions(key, *order)
                  .withColumn("_pid", F.spark_partition_id())
                  .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("double")))
    x = F.when(y.isNotNull(), F.col("_pos"))
    n = F.count(y)
    seg = t.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"), n.alias("_n"),
                                     F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.covar_pop(y, x) * n).alias("_c"),
                                     (F.var_pop(x) * n).alias("_v"), *extra)
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    return seg.withColumn("_mx", F.col("_mx") - F.col("_first") + start)


def _centred(seg: DataFrame, key: str, n: str, *means: str) -> DataFrame:
    """The means of the segments less their person's mean."""
    w = Window.partitionBy(key)
    return seg.withColumns({m: F.col(m) - F.sum(F.col(n) * F.col(m)).over(w) / F.sum(n).over(w) for m in means})


def _slope() -> F.Column:
    c = F.sum(F.col("_c") + F.col("_n") * F.col("_mx") * F.col("_my"))
    v = F.sum(F.col("_v") + F.col("_n") * F.col("_mx") * F.col("_mx"))
    return F.coalesce(F.when(v > 0, c / v), F.lit(0.0)).alias("hr_trend")


def hr_trend(telemetry: DataFrame, key: str = "employee_key",
             order=("month_no", "ts", "event_id"), partitions: int | None = None) -> DataFrame:
    """AGG2: least-squares slope of resting HR against the row index 0..n-1.

    The index is the position in ``order`` within the person (explicit
    tie-breakers, so the result does not depend on file order).  Telemetry is
    range-partitioned by (person, order), so a person with any number of readings
    spans as many tasks as needed; every partition reduces its part of a person to
    counts, means and centred sums, and these few rows are merged per person.
    A single reading has no slope; the reference never supports it and we return 0.
    """
    seg = _segments(telemetry.select(key, "resting_hr", *order), key, order, partitions=partitions)
    return _centred(seg, key, "_n", "_mx", "_my").groupBy(key).agg(_slope())


def rollup_telemetry_with_trend(telemetry: DataFrame, key: str = "employee_key",
                                order=("month_no", "ts", "event_id"), partitions: int | None = None) -> DataFrame:
    """AGG1 + AGG2 fused: the segments of ``hr_trend`` also carry the sums of the other columns."""
    means = {"avg_daily_steps": "avg_daily_steps", "avg_resting_hr": "resting_hr", "avg_active_mins": "active_minutes",
             "avg_sleep_hours": "sleep_hours", "avg_spo2": "spo2"}
    steps = F.col("avg_daily_steps").cast("double")
    extra = [e for out, c in means.items() for e in (F.sum(F.col(c).cast("double")).alias(f"_s_{out}"),
                                                     F.count(c).alias(f"_n_{out}"))]
    extra += [F.avg(steps).alias("_ms"), (F.var_pop(steps) * F.count(steps)).alias("_vs")]
    columns = dict.fromkeys([key, *order, *means.values()])
    seg = _segments(telemetry.select(*columns), key, order, extra, partitions)
    seg = _centred(_centred(seg, key, "_n", "_mx", "_my"), key, "_n_avg_daily_steps", "_ms")
    n = F.sum("_n_avg_daily_steps")
    spread = F.sum(F.col("_vs") + F.col("_n_avg_daily_steps") * F.col("_ms") * F.col("_ms"))
    avg = {out: (F.sum(f"_s_{out}") / F.nullif(F.sum(f"_n_{out}"), F.lit(0))).alias(out) for out in means}
    return seg.groupBy(key).agg(
        avg["avg_daily_steps"], F.when(n > 1, F.sqrt(spread / (n - 1))).alias("step_volatility"),
        avg["avg_resting_hr"], _slope(), avg["avg_active_mins"], avg["avg_sleep_hours"], avg["avg_spo2"])


def rollup_claims(clinical: DataFrame, key: str = "employee_key") -> DataFrame:
    """AGG3: total claim amount, event count and hospitalisations per person."""
    return clinical.groupBy(key).agg(
        F.sum("claim_amount").alias("total_claims"),
        F.count("event_id").cast("int").alias("visit_count"),
        F.sum(F.col("hospitalized").cast("int")).cast("int").alias("hospitalized_count"),
    )


def join_rollups(employees: DataFrame, tele: DataFrame, claims: DataFrame,
                 key: str = "employee_key") -> DataFrame:
    """AGG4: employees LEFT JOIN telemetry rollup LEFT JOIN claims rollup.

    Claims, visits, hospitalisations, volatility and trend default to 0; the
    other telemetry means stay null (filled later by the feature step).
    """
    df = employees.join(tele, key, "left").join(claims, key, "left")
    return df.withColumns({
        "total_claims": F.coalesce("total_claims", F.lit(0.0)),
        "visit_count": F.coalesce("visit_count", F.lit(0)),
        "hospitalized_count": F.coalesce("hospitalized_count", F.lit(0)),
        "step_volatility": F.coalesce("step_volatility", F.lit(0.0)),
        "hr_trend": F.coalesce("hr_trend", F.lit(0.0)),
    })


def premium_share(df: DataFrame, employees: DataFrame, companies: DataFrame) -> DataFrame:
    """AGG5: company base premium divided by the company's head-count.

    Head-count is a partial+final aggregate of the roster (one row per company),
    joined back; the company dimension is joined on ``company_id``.  Both sides
    are one row per company, so AQE broadcasts them when they are small and
    falls back to a shuffle join when they are not.  Inner join semantics:
    employees of unknown companies drop out, as in the reference.
    """
    counts = employees.groupBy("company_id").agg(F.count(F.lit(1)).alias("_emp_count"))
    dim = companies.select("company_id", F.col("base_premium").cast("double").alias("_base"))
    return (df.join(dim, "company_id", "left")
              .join(counts, "company_id", "inner")
              .withColumn("premium_share", F.col("_base") / F.col("_emp_count"))
              .drop("_base", "_emp_count"))


def loss_ratio(df: DataFrame, high_risk_threshold: float = 1.2) -> DataFrame:
    """AGG6: loss ratio (4 dp), high-risk flag (> 1.2) and chronic count."""
    lr = round_even(F.try_divide(F.col("total_claims"), F.col("premium_share")), 4)
    return df.withColumns({
        "loss_ratio": lr,
        "high_risk": (lr > high_risk_threshold).cast("int"),
        "chronic_count": (F.col("diabetic") + F.col("hypertension")).cast("int"),
    })


SNAPSHOT_COLUMNS = [
    "employee_key", "company_id", "age", "gender", "bmi", "smoker", "diabetic", "hypertension",
    "job_category", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend",
    "avg_active_mins", "avg_sleep_hours", "avg_spo2", "total_claims", "visit_count",
    "hospitalized_count", "premium_share", "loss_ratio", "high_risk", "chronic_count",
]


def build_snapshot(employees: DataFrame, telemetry: DataFrame, clinical: DataFrame,
                   companies: DataFrame, key: str = "employee_key") -> DataFrame:
    """AGG7: the whole training snapshot (AGG1-AGG6): aggregate before joining."""
    return snapshot_of(employees, rollup_telemetry_with_trend(telemetry, key), rollup_claims(clinical, key), companies, key)


def snapshot_of(employees: DataFrame, telemetry_rollup: DataFrame, claims_rollup: DataFrame, companies: DataFrame,
                key: str = "employee_key") -> DataFrame:
    """AGG7 from finished rollups, which several rosters can share."""
    df = join_rollups(employees, telemetry_rollup, claims_rollup, key)
    df = premium_share(df, employees, companies)
    return loss_ratio(df).select(*SNAPSHOT_COLUMNS)


def latest_lab_flags(labs: DataFrame, as_of: str | None = None, uid: str = "unique_id", code: str = "marker_code",
                     status: str = "status", risk: str = "risk_level", date: str = "report_date") -> DataFrame:
    """AGG7: per person the nine domain flags as of a date: 1 if the domain's latest results by then are out of range.

    Of several results on the latest day one out of range is enough; lines without a known marker or a date do not
    count, and a domain without results has a null flag.  A result is one number (day, flag), so the wide
    aggregate is a plain partial + final maximum however many results a person has.
    """
    from ..functions.constants import LAB_DOMAINS
    from .harmonize import is_out_of_range, marker_domain
    d = marker_domain(labs, code).withColumn("_day", F.unix_date(F.col(date).cast("date")))
    if as_of:
        d = d.where(F.col("_day") <= F.unix_date(F.lit(as_of).cast("date")))
    result = F.col("_day").cast("long") * 2 + F.coalesce(is_out_of_range(status, risk).cast("int"), F.lit(0))
    return d.groupBy(F.col(uid).cast("string").alias("_person")).agg(*[
        F.pmod(F.max(F.when(F.col("domain") == dom, result)), F.lit(2)).cast("int").alias(f"lab_{dom}_flag") for dom in LAB_DOMAINS])


def attach_lab_flags(snapshot: DataFrame, labs: DataFrame, as_of: str | None = None, key: str = "employee_key", **columns) -> DataFrame:
    """AGG7 + SRC5: the snapshot with each person's lab flags as of its date; people or domains without results get 0."""
    flags = latest_lab_flags(labs, as_of, **columns)
    rows = snapshot.join(flags, snapshot[key] == flags["_person"], "left").drop("_person")
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit(0)) for f in LAB_FLAGS})


# --- lab-derived rows -----------------------------------------------------------

def lab_risk_counts(labs: DataFrame, key: str = "unique_id") -> DataFrame:
    """AGG8: per user, markers with risk 'high' / 'medium', out-of-range markers, non-null markers."""
    return labs.groupBy(key).agg(
        F.count_if(F.col("risk_level") == "high").cast("int").alias("lab_high_count"),
        F.count_if(F.col("risk_level") == "medium").cast("int").alias("lab_medium_count"),
        F.count_if(F.col("status") == "outofrange").cast("int").alias("lab_oor_count"),
        F.count("marker_code").cast("int").alias("lab_total_tests"),
    )


def latest_non_null(df: DataFrame, key: str, order: str, columns=None) -> DataFrame:
    """AGG9: per key, the value of each column at the greatest ``order`` among rows where it is not null.

    This is pandas ``groupby(...).last()`` after sorting: per column, skipping nulls.
    ``max_by`` with a FILTER is a partial+final aggregate (no window, no sort).
    """
    columns = [c for c in (columns or df.columns) if c not in (key, order)]
    aggs = [F.expr(f"max_by(`{c}`, `{order}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns]
    return df.groupBy(key).agg(F.max(order).alias(order), *aggs)


def domain_flags(df: DataFrame, domain_columns: dict) -> DataFrame:
    """AGG10: each domain status column -> 0/1 flag (``'outofrange'`` only; null -> 0)."""
    out = df
    for src, flag in domain_columns.items():
        out = out.withColumn(flag, F.coalesce((F.col(src) == "outofrange").cast("int"), F.lit(0)))
    return out


def annual_to_daily(df: DataFrame) -> DataFrame:
    """AGG11: yearly totals -> daily metrics."""
    return (df.withColumn("avg_daily_steps",
                          F.greatest(round_even(F.coalesce("step_count", F.lit(0.0)) / 365, 0), F.lit(0.0)))
              .withColumn("avg_active_mins",
                          F.greatest(round_even(F.coalesce("total_active_minutes", F.lit(0.0)) / 365, 1), F.lit(0.0)))
              .withColumn("step_volatility",
                          round_even(clamp(F.coalesce("mindful_min", F.lit(0.0)) / 365 * 120 + 400, 100, 3000), 0)))


def lab_aggregates(df: DataFrame) -> DataFrame:
    """AGG13: lab flag count and weighted lab risk score (4 dp)."""
    count = sum((F.col(f) for f in LAB_FLAGS), F.lit(0))
    score = sum((F.lit(LAB_WEIGHTS[f]) * F.col(f) for f in LAB_FLAGS), F.lit(0.0))
    return (df.withColumn("lab_domain_count", count.cast("int"))
              .withColumn("lab_risk_score", round_even(score, 4)))


def snapshot_summary(df: DataFrame) -> DataFrame:
    """AGG15: one-row sanity summary of a training snapshot."""
    aggs = [
        F.min("loss_ratio").alias("lr_min"),
        F.max("loss_ratio").alias("lr_max"),
        F.avg("loss_ratio").alias("lr_mean"),
        (F.avg(F.col("high_risk").cast("double")) * 100).alias("high_risk_pct"),
        F.avg("avg_daily_steps").alias("mean_steps"),
        F.avg("avg_resting_hr").alias("mean_resting_hr"),
        (F.avg(F.col("diabetic").cast("double")) * 100).alias("diabetic_pct"),
        F.count(F.lit(1)).alias("rows"),
    ]
    if "lab_domain_count" in df.columns:
        aggs += [F.avg("lab_domain_count").alias("lab_domain_count_mean"),
                 F.avg("lab_risk_score").alias("lab_risk_score_mean")]
    aggs += [F.avg(F.col(f).cast("double")).alias(f"{f}_rate") for f in LAB_FLAGS if f in df.columns]
    return df.agg(*aggs)



def poisson_from_uniform(lam, u, kmax: int = 15) -> F.Column:
    """Inverse-CDF Poisson draw: the number of CDF(k), k < kmax, lying below ``u`` (capped at kmax).

    The terms are folded over k; ``lam`` and ``u`` should be columns, as every step reads them."""
    term = F.exp(-lam)
    start = F.struct(term.alias("term"), term.alias("cdf"), (u > term).cast("int").alias("n"))

    def step(acc, k):
        nxt = acc["term"] * lam / k
        cdf = acc["cdf"] + nxt
        return F.struct(nxt.alias("term"), cdf.alias("cdf"), (acc["n"] + (u > cdf).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(kmax - 1)), start, step, lambda acc: acc["n"])


# Activity domain column -> lab flag.
ACTIVITY_FLAG_COLUMNS = {
    "bone_health": "lab_bone_flag", "diabetes": "lab_diabetes_flag", "heart_health": "lab_heart_flag",
    "inflammation": "lab_inflammation_flag", "iron": "lab_iron_flag", "kidney_health": "lab_kidney_flag",
    "liver_health": "lab_liver_flag", "thyroid_health": "lab_thyroid_flag", "vitamin_deficiency": "lab_vitamin_flag",
}


def lab_training_rows(activity: DataFrame, key: str = "user_id", order: str = "year", jitter: bool = True,
                      seed: int = 42) -> DataFrame:
    """AGG12: yearly activity + lab domains -> training rows (AGG9 latest per user, AGG10, AGG11, AGG13).

    Demographics, wearable proxies and claims are drawn with keyed jitter from
    the lab burden; visits are a Poisson draw (inverse CDF of one uniform).
    """
    from ..functions.expr import keyed_normal, keyed_uniform

    latest = latest_non_null(activity, key, order)
    d = annual_to_daily(domain_flags(latest, ACTIVITY_FLAG_COLUMNS))
    k = F.col(key)
    N = (lambda name, m, s: keyed_normal(k, name, m, s, seed)) if jitter else (lambda name, m, s: F.lit(float(m)))
    U = (lambda name: keyed_uniform(k, name, seed)) if jitter else (lambda name: F.lit(0.5))
    n = sum((F.col(f) for f in LAB_FLAGS), F.lit(0))
    d = d.withColumn("lab_domain_count", n.cast("int"))
    n = F.col("lab_domain_count")
    d = (d.withColumn("age", clamp(N("age", 34, 7) + n * 1.8, 22.0, 62.0).cast("int"))
          .withColumn("bmi", round_even(clamp(N("bmi", 23.5, 3.2) + F.col("lab_heart_flag") * 2.5
                                              + F.col("lab_diabetes_flag") * 3.0, 16.0, 42.0), 1))
          .withColumn("smoker", (U("smoker") < clamp(F.lit(0.08) + F.col("lab_inflammation_flag") * 0.14
                                                     + F.col("lab_heart_flag") * 0.10 + F.col("lab_liver_flag") * 0.08,
                                                     0.0, 0.85)).cast("int"))
          .withColumn("diabetic", F.col("lab_diabetes_flag"))
          .withColumn("hypertension", F.col("lab_heart_flag"))
          .withColumn("chronic_count", (F.col("diabetic") + F.col("hypertension")).cast("int"))
          .withColumn("avg_resting_hr", round_even(clamp(N("avg_resting_hr", 70, 7) + F.col("lab_heart_flag") * 5
                                                         + F.col("smoker") * 3 - F.col("avg_daily_steps") / 3500,
                                                         55.0, 102.0), 1))
          .withColumn("hr_trend", N("hr_trend", 0, 0.15))
          .withColumn("avg_sleep_hours", round_even(clamp(N("avg_sleep_hours", 6.8, 0.75), 4.5, 9.5), 1))
          .withColumn("avg_spo2", round_even(clamp(N("avg_spo2", 97.5, 0.5) - F.col("smoker") * 1.2, 90.0, 100.0), 1))
          .withColumns({"_lam": F.lit(1.5) + n * 0.55, "_draw": U("visit_count")})
          .withColumn("visit_count", F.least(poisson_from_uniform(F.col("_lam"), F.col("_draw")), F.lit(15)))
          .withColumn("hospitalized_count", (U("hospitalized_count") < n * 0.04).cast("int")))
    d = lab_aggregates(d)
    activity_factor = clamp(F.lit(1.0) - F.col("avg_daily_steps") / 10000, 0.0, 1.0)
    risk = F.col("lab_risk_score") * 3.0 + activity_factor + F.col("smoker") * 0.45 + F.col("chronic_count") * 0.35
    noise = F.lit(0.65) + U("noise") * 0.75
    d = d.withColumn("premium_share", round_even(F.lit(4500.0) + U("premium_share") * 7500.0, 0))
    d = d.withColumn("total_claims", F.greatest(round_even(F.expm1(risk) * F.col("premium_share") * 0.16 * noise, 2),
                                                F.lit(0.0)))
    d = d.withColumn("loss_ratio", clamp(round_even(F.col("total_claims") / F.col("premium_share"), 4), 0.0, 120.0))
    d = d.withColumn("high_risk", (F.col("loss_ratio") > 1.2).cast("int"))
    d = (d.withColumn("employee_id", F.concat(F.lit("REAL_"), k.cast("string")))
          .withColumn("company_id", F.lit("REAL_DATA"))
          .withColumn("gender", F.when(U("gender") < 0.54, "M").otherwise("F"))
          .withColumn("job_category", F.when(U("job_category") < 0.40, "desk")
                      .when(U("job_category") < 0.75, "field").otherwise("manual")))
    keep = ["employee_id", "company_id", "age", "gender", "bmi", "smoker", "diabetic", "hypertension", "job_category",
            "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins", "avg_sleep_hours",
            "avg_spo2", "total_claims", "visit_count", "hospitalized_count", "premium_share", "loss_ratio", "high_risk",
            "chronic_count", "lab_bone_flag", "lab_diabetes_flag", "lab_heart_flag", "lab_inflammation_flag",
            "lab_iron_flag", "lab_kidney_flag", "lab_liver_flag", "lab_thyroid_flag", "lab_vitamin_flag",
            "lab_domain_count", "lab_risk_score"]
    return d.select(*keep)


def extend_training(base: DataFrame, extra: DataFrame) -> DataFrame:
    """AGG14: append another source's rows aligned to the base columns (absent -> 0)."""
    from .harmonize import align_and_union
    return align_and_union(base, extra)
