"""Data quality (DQ1-DQ8), fairness audit (FAI1-FAI6) and environment parity (PAR1-PAR3).

Profiles are single aggregates over all columns (one scan, partial+final),
unpivoted afterwards; only the small per-column result is reshaped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.constants import FEATURE_COLUMNS
from ..functions.expr import round_even


def _numeric(df: DataFrame):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def profile_columns(df: DataFrame) -> DataFrame:
    """DQ1: per column: position, Spark type, null % (and the row count)."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}")
                                      for i, c in enumerate(df.columns)])
    spark = df.sparkSession
    meta = spark.createDataFrame([(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, dtype string")
    long = wide.unpivot(["_rows"], [f"_n{i}" for i in range(len(df.columns))], "_k", "nulls") \
        .withColumn("position", F.substring("_k", 3, 10).cast("int") + 1)
    return meta.join(long, "position").select(
        "position", "column", "dtype", F.col("_rows").alias("rows"),
        (F.col("nulls") / F.col("_rows") * 100).alias("null_pct"))


def describe_numeric(df: DataFrame, columns=None) -> DataFrame:
    """DQ2: count, mean, std, min, 25%, 50%, 75%, max per numeric column (long form).

    Moments are one aggregate over all columns; quartiles are one grouped exact
    selection over the stacked columns.
    """
    from ..functions.stats import exact_column_percentiles
    from ..session import materialize
    cols = columns or _numeric(df)
    df = materialize(df.select(*cols), "describe")  # read by the moments and the quartiles
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{i}|count"), F.avg(x).alias(f"{i}|mean"),
                 F.stddev_samp(x).alias(f"{i}|std"), F.min(x).alias(f"{i}|min"), F.max(x).alias(f"{i}|max")]
    wide = df.agg(*aggs)
    long = wide.unpivot([], [f"`{n}`" for n in wide.columns], "_k", "value")
    idx = F.split("_k", r"\|")
    lookup = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(str(i)), F.lit(c))])
    moments = long.select(F.element_at(lookup, idx[0]).alias("column"), idx[1].alias("stat"), "value")
    q = exact_column_percentiles(df, cols, {"25%": 0.25, "50%": 0.5, "75%": 0.75})
    quart = q.unpivot(["column"], ["`25%`", "`50%`", "`75%`"], "stat", "value")
    return moments.unionByName(quart)


def target_summary(df: DataFrame, target: str = "loss_ratio") -> DataFrame:
    """DQ3: min, Q1, mean, Q3, max of the target (quartiles by exact selection)."""
    from ..functions.stats import exact_percentiles
    x = F.col(target).cast("double")
    q = exact_percentiles(df, target, {"q1": 0.25, "q3": 0.75})
    return df.agg(F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max")).crossJoin(q) \
        .select("min", "q1", "mean", "q3", "max")


def feature_coverage(df: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    """DQ4: which model features the frame provides, and in how many rows each has a value (one aggregate)."""
    present = set(df.columns)
    counts = df.agg(*[F.count(F.col(f)).alias(f) for f in features if f in present], F.count(F.lit(1)).alias("_rows"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(f).alias("feature"), F.lit(f in present).alias("available"),
                 (F.col(f) if f in present else F.lit(0).cast("long")).alias("filled")) for i, f in enumerate(features)])))


def completeness(df: DataFrame) -> DataFrame:
    """DQ5: percent of non-null cells, and the missing-cell count."""
    cells = F.count(F.lit(1)) * len(df.columns)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    return df.agg((F.lit(1.0) - missing / cells).alias("_c"), missing.alias("missing_cells")) \
        .select((F.col("_c") * 100).alias("completeness_pct"), "missing_cells")


def duplicate_count(df: DataFrame, key) -> DataFrame:
    """DQ6: rows beyond the first per key (nulls are a key value, as in pandas ``duplicated``)."""
    keys = [key] if isinstance(key, str) else list(key)
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
                   F.count(F.lit(1)).alias("distinct_keys"))


def type_and_range(df: DataFrame, first_n: int = 5) -> DataFrame:
    """DQ7: numeric / string / other column counts and min-max of the first five numeric columns."""
    num = _numeric(df)
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    rng = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"))
                   .alias(c) for c in num[:first_n]])
    long = rng.unpivot([], num[:first_n], "column", "r")
    counts = F.struct(F.lit(len(num)).alias("numeric"), F.lit(len(strs)).alias("object"),
                      F.lit(len(df.columns) - len(num) - len(strs)).alias("other"))
    return long.select("column", F.col("r.min").alias("min"), F.col("r.max").alias("max"),
                       counts.alias("column_kinds"))


def assertions(snapshot: DataFrame, employees: DataFrame, key_cols=("employee_id", "company_id", "age", "bmi"),
               id_col: str = "employee_id", raw_prefix: str = "EMP_") -> DataFrame:
    """DQ8: data assertions as rows (check, passed, value)."""
    e = employees.agg(
        F.count(F.lit(1)).alias("n_emp"),
        sum((F.count_if(F.col(c).isNull()) for c in key_cols if c in employees.columns), F.lit(0)).alias("key_nulls"),
        F.count_if(F.col(id_col).startswith(raw_prefix)).alias("raw_ids"))
    from ..functions.stats import exact_percentiles
    s = snapshot.agg(
        F.min("loss_ratio").alias("lr_min"), F.count_if(F.col("loss_ratio").isNull()).alias("lr_nulls"),
        F.avg(F.when(F.col("loss_ratio") < 50, 1.0).otherwise(0.0)).alias("pct_normal"),
        F.corr(F.col("avg_daily_steps").cast("double"), F.col("loss_ratio")).alias("corr_steps_lr")) \
        .crossJoin(exact_percentiles(snapshot, "loss_ratio", {"lr_median": 0.5}))
    r = e.crossJoin(s)
    def chk(name, passed, value):
        return F.struct(F.lit(name).alias("check"), passed.alias("passed"), value.cast("double").alias("value"))

    checks = F.array(
        chk("employees_present", F.col("n_emp") > 0, F.col("n_emp")),
        chk("no_null_keys", F.col("key_nulls") == 0, F.col("key_nulls")),
        chk("loss_ratio_non_negative", F.col("lr_min") >= 0, F.col("lr_min")),
        chk("loss_ratio_not_null", F.col("lr_nulls") == 0, F.col("lr_nulls")),
        chk("median_in_range", (F.col("lr_median") > 0) & (F.col("lr_median") < 10), F.col("lr_median")),
        chk("share_below_50", F.col("pct_normal") > 0.9, F.col("pct_normal")),
        chk("steps_lr_correlation", F.coalesce(F.col("corr_steps_lr") < -0.1, F.lit(False)), F.col("corr_steps_lr")),
        chk("ids_pseudonymised", F.col("raw_ids") == 0, F.col("raw_ids")),
    )
    return r.select(F.inline(checks))


# ---- fairness -------------------------------------------------------------------------

def join_gender(snapshot: DataFrame, employees: DataFrame, key: str = "employee_key") -> DataFrame:
    """FAI6: snapshot JOIN roster; the roster's gender wins."""
    return snapshot.drop("gender").join(employees.select(key, "gender"), key, "inner")


def align_features(df: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    """FAI5: model features absent from the frame are added as 0; nulls become 0."""
    out = df
    for f in features:
        out = out.withColumn(f, F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in df.columns else F.lit(0.0))
    return out


def score_hrs_audit(df: DataFrame, scorer: DataFrame, col: str = "log_pred", out: str = "hrs") -> DataFrame:
    """FAI1: clip the log prediction into [p05, p95] and scale by max(p95 - p05, 1e-6) to 0-100."""
    s = scorer.select("p05", "p95")
    clipped = F.least(F.greatest(F.col(col), F.col("p05")), F.col("p95"))
    return (df.crossJoin(F.broadcast(s))
              .withColumn(out, (clipped - F.col("p05")) / F.greatest(F.col("p95") - F.col("p05"), F.lit(1e-6)) * 100)
              .drop("p05", "p95"))


def fairness_report(df: DataFrame, group: str = "gender", hrs: str = "hrs") -> DataFrame:
    """FAI2: per group: n, mean/median/std HRS and shares <40, 40-60, 60-80, >=80 (audit band edges).

    Means and shares are one partial+final aggregate; the median is an exact
    grouped selection (a group may hold a large share of all rows, and HRS is
    continuous, so a per-group value map would not be bounded).
    """
    from ..functions.stats import exact_group_percentiles
    from ..session import materialize
    src = materialize(df.select(group, hrs), "fairness")
    h = F.col(hrs)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100
    a = src.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("mean_hrs"),
        F.stddev_samp(h).alias("std_hrs"), share(h < 40).alias("pct_low"),
        share((h >= 40) & (h < 60)).alias("pct_moderate"), share((h >= 60) & (h < 80)).alias("pct_high"),
        share(h >= 80).alias("pct_critical"))
    med = exact_group_percentiles(src, group, hrs, {"median_hrs": 0.5}, materialize_input=False)
    return a.join(med, group, "left").select(group, "n", "mean_hrs", "median_hrs", "std_hrs", "pct_low",
                                            "pct_moderate", "pct_high", "pct_critical")


def parity_gap(report: DataFrame, limit: float = 5.0) -> DataFrame:
    """FAI3: largest gap between group mean HRS; passes when <= 5 points."""
    return report.agg((F.max("mean_hrs") - F.min("mean_hrs")).alias("max_gap")) \
        .withColumn("passed", F.col("max_gap") <= limit)


def age_report(df: DataFrame, hrs: str = "hrs") -> DataFrame:
    """FAI4: age buckets (17,29] .. (59,70]: n, mean, std (1 dp), and whether the mean rises.

    ``lag`` runs over the five bucket rows only.
    """
    a = F.col("age")
    bucket = (F.when((a > 17) & (a <= 29), "18-29").when((a > 29) & (a <= 39), "30-39")
               .when((a > 39) & (a <= 49), "40-49").when((a > 49) & (a <= 59), "50-59")
               .when((a > 59) & (a <= 70), "60-70"))
    r = df.where(bucket.isNotNull()).groupBy(bucket.alias("age_bucket")).agg(
        F.count(F.lit(1)).alias("n"), round_even(F.avg(hrs), 1).alias("mean_hrs"),
        round_even(F.stddev_samp(hrs), 1).alias("std_hrs"))
    w = Window.orderBy("age_bucket")
    prev = F.lag("mean_hrs").over(w)
    return r.withColumn("non_decreasing", F.when(prev.isNull(), F.lit(True)).otherwise(F.col("mean_hrs") >= prev))


# ---- environment parity -------------------------------------------------------------------

def key_parity(a: DataFrame, b: DataFrame, key: str = "company_id") -> DataFrame:
    """PAR1: each key with where it appears: only_left / only_right / both."""
    l = a.select(key).distinct().withColumn("_l", F.lit(True))
    r = b.select(key).distinct().withColumn("_r", F.lit(True))
    j = l.join(r, key, "full_outer")
    return j.select(key, F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l").isNotNull(), "only_left")
                    .otherwise("only_right").alias("presence"))


def count_parity(a: DataFrame, b: DataFrame, key: str = "company_id") -> DataFrame:
    """PAR2: rows per key in each environment and whether they match."""
    ca = a.groupBy(key).agg(F.count(F.lit(1)).alias("left_count"))
    cb = b.groupBy(key).agg(F.count(F.lit(1)).alias("right_count"))
    j = ca.join(cb, key, "full_outer")
    return j.withColumn("match", F.coalesce(F.col("left_count") == F.col("right_count"), F.lit(False)))


def score_parity(a: DataFrame, b: DataFrame, key: str = "company_id", score: str = "mean_hrs",
                 band: str = "risk_band") -> DataFrame:
    """PAR3: per common key: both scores, |delta|, band match; plus the mean |delta| over keys."""
    j = a.select(key, F.col(score).alias("left_score"), F.col(band).alias("left_band")).join(
        b.select(key, F.col(score).alias("right_score"), F.col(band).alias("right_band")), key, "inner")
    j = j.withColumn("abs_delta", F.abs(F.col("left_score") - F.col("right_score"))) \
         .withColumn("band_match", F.col("left_band") == F.col("right_band"))
    return j.crossJoin(F.broadcast(j.agg(F.avg("abs_delta").alias("mean_abs_delta"))))
