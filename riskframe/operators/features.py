"""Feature engineering (FEA1-FEA11): pure projections, one codegen stage, no shuffle."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CORE_FILLS, FEATURE_COLUMNS, LAB_FLAGS, TARGET, TARGET_LOG
from ..functions.expr import clamp, round_even


def clamp_inputs(df: DataFrame) -> DataFrame:
    """FEA1: chronic count -> int 0..4 (null -> 0); bmi clamped to 15..50 (null stays null)."""
    if "chronic_count" in df.columns:
        df = df.withColumn("chronic_count",
                           F.least(F.greatest(F.coalesce(F.col("chronic_count").cast("double"), F.lit(0.0)),
                                              F.lit(0.0)), F.lit(4.0)).cast("int"))
    if "bmi" in df.columns:
        df = df.withColumn("bmi", clamp(F.col("bmi").cast("double"), 15.0, 50.0))
    return df


def encode_categoricals(df: DataFrame) -> DataFrame:
    """FEA2: ``gender_male`` (0 when gender is absent or null); boolean flags -> int."""
    if "gender" in df.columns:
        df = df.withColumn("gender_male", F.coalesce((F.col("gender") == "M").cast("int"), F.lit(0)))
    else:
        df = df.withColumn("gender_male", F.lit(0))
    for c in ("smoker", "diabetic", "hypertension"):
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("int"))
    return df


def fill_core(df: DataFrame) -> DataFrame:
    """FEA3: constant null fills for the core telemetry/clinical columns that exist."""
    for c, v in CORE_FILLS.items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)))
    return df


def fill_labs(df: DataFrame) -> DataFrame:
    """FEA4: lab flags absent or null -> 0, as int."""
    for c in LAB_FLAGS:
        df = df.withColumn(c, F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in df.columns else F.lit(0))
    return df


def activity_score_expr(steps="avg_daily_steps", hr="avg_resting_hr", sleep="avg_sleep_hours"):
    steps_n = clamp(F.col(steps) / 10000.0, 0.0, 1.2)
    hr_n = clamp((F.lit(80.0) - F.col(hr)) / 30.0, 0.0, 1.0)
    sleep_n = clamp(F.lit(1.0) - F.abs(F.col(sleep) - 7.5) / 3.0, 0.0, 1.0)
    return round_even((steps_n + hr_n + sleep_n) / 3.0 * 100.0, 2)


def activity_score(df: DataFrame) -> DataFrame:
    """FEA5: 0-100 activity score (higher is healthier; max 106.67)."""
    return df.withColumn("activity_score", activity_score_expr())


def health_composite(df: DataFrame) -> DataFrame:
    """FEA6: penalty score 15*smoker + 20*diabetic + 15*hypertension + 1.5*clip(bmi-25,0,20) + age/6."""
    e = (F.col("smoker") * 15 + F.col("diabetic") * 20 + F.col("hypertension") * 15
         + clamp(F.col("bmi") - 25.0, 0.0, 20.0) * 1.5 + (F.col("age") / 60.0) * 10)
    return df.withColumn("health_composite", round_even(e, 2))


def interactions(df: DataFrame) -> DataFrame:
    """FEA7: smoker x diabetic, (bmi/25)(age/40), visits x (1 + hospitalisations)."""
    return (df.withColumn("smoker_diabetic", (F.col("smoker") * F.col("diabetic")).cast("int"))
              .withColumn("bmi_age_risk", (F.col("bmi") / 25.0) * (F.col("age") / 40.0))
              .withColumn("clinical_burden", F.col("visit_count") * (F.lit(1) + F.col("hospitalized_count"))))


def log_target(df: DataFrame) -> DataFrame:
    """FEA8: ``loss_ratio_log = log1p(loss_ratio)`` when the target is present."""
    if TARGET in df.columns:
        df = df.withColumn(TARGET_LOG, F.log1p(F.col(TARGET).cast("double")))
    return df


def _base_columns(df: DataFrame) -> dict:
    """FEA1-FEA4 as one batch of independent column expressions."""
    cols = {}
    if "chronic_count" in df.columns:
        cols["chronic_count"] = F.least(F.greatest(F.coalesce(F.col("chronic_count").cast("double"), F.lit(0.0)),
                                                   F.lit(0.0)), F.lit(4.0)).cast("int")
    if "bmi" in df.columns:
        cols["bmi"] = clamp(F.col("bmi").cast("double"), 15.0, 50.0)
    cols["gender_male"] = (F.coalesce((F.col("gender") == "M").cast("int"), F.lit(0))
                           if "gender" in df.columns else F.lit(0))
    for c in ("smoker", "diabetic", "hypertension"):
        if c in df.columns:
            cols[c] = F.col(c).cast("int")
    for c, v in CORE_FILLS.items():
        if c in df.columns:
            cols[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    for c in LAB_FLAGS:
        cols[c] = F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in df.columns else F.lit(0)
    return cols


def engineer_features(df: DataFrame) -> DataFrame:
    """FEA9: FEA1-FEA8 plus the lab aggregates (AGG13), in the reference order.

    Three projections (base fixes, derived features, target), each one batch of
    column expressions, so the plan stays shallow and is analysed once per level.
    """
    from ..functions.constants import LAB_WEIGHTS
    df = df.withColumns(_base_columns(df))
    health = (F.col("smoker") * 15 + F.col("diabetic") * 20 + F.col("hypertension") * 15
              + clamp(F.col("bmi") - 25.0, 0.0, 20.0) * 1.5 + (F.col("age") / 60.0) * 10)
    lab_score = sum((F.lit(LAB_WEIGHTS[f]) * F.col(f) for f in LAB_FLAGS), F.lit(0.0))
    df = df.withColumns({
        "activity_score": activity_score_expr(),
        "health_composite": round_even(health, 2),
        "smoker_diabetic": (F.col("smoker") * F.col("diabetic")).cast("int"),
        "bmi_age_risk": (F.col("bmi") / 25.0) * (F.col("age") / 40.0),
        "clinical_burden": F.col("visit_count") * (F.lit(1) + F.col("hospitalized_count")),
        "lab_domain_count": sum((F.col(f) for f in LAB_FLAGS), F.lit(0)).cast("int"),
        "lab_risk_score": round_even(lab_score, 4),
    })
    return log_target(df)


class FeatureContractError(ValueError):
    pass


def feature_matrix(df: DataFrame, features=FEATURE_COLUMNS, output: str = "features") -> DataFrame:
    """FEA10: fail listing missing features; else assemble the ordered vector (+ target if present)."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise FeatureContractError(f"Training data is missing declared features: {missing}")
    from pyspark.ml.feature import VectorAssembler

    keep = [c for c in df.columns if c not in features]
    va = VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep")
    return va.transform(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]))


def engineer_features_audit(df: DataFrame) -> DataFrame:
    """FEA11: the fairness audit's own variant of the derived features (kept separate).

    activity = 40*clip(steps,0,20000)/20000 + 30*clip(active,0,120)/120 + 30*(clip(SpO2,85,100)-85)/15;
    composite = 30 smoker + 25 diabetic + 20 hypertension + 15*(clip(bmi,18,50)-18)/32 + 10*clip(chronic,0,5)/5;
    bmi_age_risk = (clip(bmi,18,50)-18)*(age-18)/(32*52); burden = visits + 3*hospitalisations;
    lab score with integer weights (heart, diabetes 3; kidney, liver, inflammation 2; others 1).
    No null fills here: nulls propagate, as in the audit (FAI5 zero-fills afterwards).
    """
    act = (clamp("avg_daily_steps", 0.0, 20000.0) / 20000.0 * 40
           + clamp("avg_active_mins", 0.0, 120.0) / 120.0 * 30
           + (clamp("avg_spo2", 85.0, 100.0) - 85.0) / 15.0 * 30)
    comp = (F.col("smoker") * 30 + F.col("diabetic") * 25 + F.col("hypertension") * 20
            + (clamp("bmi", 18.0, 50.0) - 18.0) / 32.0 * 15
            + clamp(F.col("chronic_count").cast("double"), 0.0, 5.0) / 5.0 * 10)
    weights = {"lab_heart_flag": 3, "lab_diabetes_flag": 3, "lab_kidney_flag": 2, "lab_liver_flag": 2,
               "lab_inflammation_flag": 2}
    flags = [f for f in LAB_FLAGS if f in df.columns]
    return (df.withColumn("activity_score", act)
              .withColumn("health_composite", comp)
              .withColumn("smoker_diabetic", F.col("smoker") * F.col("diabetic"))
              .withColumn("bmi_age_risk", (clamp("bmi", 18.0, 50.0) - 18.0) * (F.col("age") - 18) / (32.0 * 52.0))
              .withColumn("clinical_burden", F.col("visit_count") + F.col("hospitalized_count") * 3)
              .withColumn("lab_domain_count", sum((F.col(f) for f in flags), F.lit(0)))
              .withColumn("lab_risk_score", sum((F.col(f) * weights.get(f, 1) for f in flags), F.lit(0))))
