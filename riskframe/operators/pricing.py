"""Pricing (PRC1-PRC13): premium zones, market multipliers, ROI and calibration.

Lookup tables with at most 20 keys are inlined as ``map`` literals (no join at
all); group statistics are partial+final aggregates.
"""
from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (CURRENCIES, DEFAULT_SUM_ASSURED, INDUSTRY_RISK_MULTIPLIERS,
                                   REGION_MULTIPLIERS, SUM_ASSURED_BAND_MULTIPLIERS, ZONE_TEXT)
from ..functions.expr import round_even


def _map_literal(d: dict) -> F.Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def sum_assured_band(c) -> F.Column:
    """PRC1: <=3 '1-3L', <=7 '4-7L', <=15 '8-15L', else '15L+'."""
    c = _c(c)
    return F.when(c <= 3, "1-3L").when(c <= 7, "4-7L").when(c <= 15, "8-15L").otherwise("15L+")


def market_multiplier(industry=None, region=None, sum_assured=None) -> F.Column:
    """PRC2: industry x region x sum-assured band; unknown or null -> 1.0; default sum assured 5."""
    m = F.lit(1.0)
    if industry is not None:
        m = m * F.coalesce(F.element_at(_map_literal(INDUSTRY_RISK_MULTIPLIERS), _c(industry)), F.lit(1.0))
    if region is not None:
        m = m * F.coalesce(F.element_at(_map_literal(REGION_MULTIPLIERS), _c(region)), F.lit(1.0))
    sa = F.coalesce(_c(sum_assured), F.lit(DEFAULT_SUM_ASSURED)) if sum_assured is not None else F.lit(DEFAULT_SUM_ASSURED)
    band = sum_assured_band(sa)
    return m * F.coalesce(F.element_at(_map_literal(SUM_ASSURED_BAND_MULTIPLIERS), band), F.lit(1.0))


def premium_columns(base, hrs, multiplier=None, prefix: str = "") -> dict:
    """PRC3 as named column expressions (shared by ``adjust_premium`` and ROI)."""
    base, h = _c(base).cast("double"), _c(hrs).cast("double")
    mult = F.lit(1.0) if multiplier is None else _c(multiplier)
    eff = base * mult
    disc = (F.lit(40.0) - h) / 40.0 * 0.15
    load = (h - 60.0) / 40.0 * 0.30
    zone = F.when(h <= 40, "discount").when(h <= 60, "standard").otherwise("loading")
    adjusted = (F.when(h <= 40, round_even(eff * (F.lit(1.0) - disc), 2))
                 .when(h <= 60, round_even(eff, 2))
                 .otherwise(round_even(eff * (F.lit(1.0) + load), 2)))
    pct = (F.when(h <= 40, round_even(-disc * 100.0, 2))
            .when(h <= 60, round_even((mult - 1.0) * 100.0, 2))
            .otherwise(round_even(load * 100.0, 2)))
    rec = (F.when(h <= 40, ZONE_TEXT["discount"]).when(h <= 60, ZONE_TEXT["standard"])
            .otherwise(ZONE_TEXT["loading"]))
    return {f"{prefix}adjusted_premium": adjusted, f"{prefix}adjustment_pct": pct,
            f"{prefix}zone": zone, f"{prefix}recommendation": rec}


def adjust_premium(df: DataFrame, base="base_premium", hrs="hrs", multiplier=None) -> DataFrame:
    """PRC3: HRS <= 40 discount up to 15%; <= 60 standard; else loading up to 30%.

    The standard zone's ``adjustment_pct`` is the market multiplier's effect only;
    the other zones' percentages exclude the multiplier (reference behaviour).
    """
    return df.withColumns(premium_columns(base, hrs, multiplier))


def wellness_roi(df: DataFrame, base="base_premium", current="current_hrs", projected="projected_hrs",
                 multiplier=None) -> DataFrame:
    """PRC4: premium now vs after a wellness programme, savings, HRS delta, zones."""
    cur = premium_columns(base, current, multiplier, "_c_")
    new = premium_columns(base, projected, multiplier, "_p_")
    return df.select(
        "*",
        cur["_c_adjusted_premium"].alias("current_premium"),
        new["_p_adjusted_premium"].alias("projected_premium"),
        round_even(cur["_c_adjusted_premium"] - new["_p_adjusted_premium"], 2).alias("annual_savings"),
        round_even(_c(current) - _c(projected), 1).alias("hrs_improvement"),
        cur["_c_zone"].alias("current_zone"),
        new["_p_zone"].alias("projected_zone"),
    )


def roi_grid(df: DataFrame, base="base_premium", hrs="hrs", max_improvement: int = 40,
             multiplier=None) -> DataFrame:
    """PRC5: for improvement 0..40 points, projected HRS = max(0, HRS - x) and the ROI row.

    ``explode(sequence)`` is narrow: 41 rows per input row, no shuffle.
    """
    g = df.withColumn("improvement", F.explode(F.sequence(F.lit(0), F.lit(max_improvement))))
    g = g.withColumn("projected_hrs", F.greatest(F.lit(0.0), F.col(hrs).cast("double") - F.col("improvement")))
    return wellness_roi(g, base, hrs, "projected_hrs", multiplier)


def estimated_claims(df: DataFrame, mean_lr="mean_loss_ratio", premium="adjusted_premium") -> DataFrame:
    """PRC12: estimated annual claims = mean loss ratio x adjusted premium."""
    return df.withColumn("estimated_claims", _c(mean_lr) * _c(premium))


def convert(df: DataFrame, amount: str, code: str, out: str | None = None) -> DataFrame:
    """PRC9: INR amount -> currency ``code`` (rate literal)."""
    rate = CURRENCIES[code][2]
    return df.withColumn(out or f"{amount}_{code.lower()}", _c(amount) * F.lit(rate))


def format_money(value, code: str) -> F.Column:
    """PRC10: symbol + thousands separators; 2 decimals below 1000 (not for JPY), else 0."""
    sym = CURRENCIES[code][0]
    v = _c(value).cast("double")
    two = F.format_number(round_even(v, 2), 2)
    zero = F.format_number(round_even(v, 0), 0)
    body = zero if code == "JPY" else F.when(v < 1000, two).otherwise(zero)
    return F.concat(F.lit(sym), body)


def format_total(value_inr, code: str) -> F.Column:
    """PRC11: portfolio totals: INR crore, JPY billion, else Bn / M / plain."""
    sym, _, rate = CURRENCIES[code]
    v = _c(value_inr).cast("double") * F.lit(rate)
    f2 = lambda x: F.format_string("%.2f", round_even(x, 2))
    nbsp = " "
    if code == "INR":
        return F.concat(F.lit("₹"), f2(v / 1e7), F.lit(nbsp + "Cr"))
    if code == "JPY":
        return F.concat(F.lit("¥"), f2(v / 1e8), F.lit(nbsp + "Bn"))
    return (F.when(v >= 1e9, F.concat(F.lit(sym), f2(v / 1e9), F.lit(nbsp + "Bn")))
             .when(v >= 1e6, F.concat(F.lit(sym), f2(v / 1e6), F.lit(nbsp + "M")))
             .otherwise(F.concat(F.lit(sym), F.format_number(round_even(v, 0), 0))))


# ---- PRC6-PRC8: multiplier calibration from market quotes ----------------------------

PREMIUM_COL = "estimated_annual_premium_per_employee_inr"


def _group_multipliers(quotes: DataFrame, by: str, premium: str) -> DataFrame:
    """Group median / overall median, both exact by distributed selection (few, possibly huge groups)."""
    from ..functions.stats import exact_group_percentiles, exact_percentiles
    from ..session import materialize
    q = materialize(quotes.select(by, premium), "quotes")
    overall = exact_percentiles(q, premium, {"_overall": 0.5}, materialize_input=False)
    g = exact_group_percentiles(q, by, premium, {"_median": 0.5})
    return (g.crossJoin(F.broadcast(overall))
             .select(F.col(by).alias("key"), round_even(F.col("_median") / F.col("_overall"), 3).alias("multiplier")))


def industry_multipliers(quotes: DataFrame, premium: str = PREMIUM_COL) -> DataFrame:
    """PRC6: median premium per industry / overall median, 3 dp."""
    return _group_multipliers(quotes, "industry", premium)


def region_multipliers(quotes: DataFrame, premium: str = PREMIUM_COL) -> DataFrame:
    """PRC7: median premium per region / overall median, 3 dp."""
    return _group_multipliers(quotes, "region", premium)


def market_multipliers(quotes: DataFrame, premium: str = PREMIUM_COL) -> DataFrame:
    """PRC6 + PRC7 in one selection: every quote is stacked three times (its industry, its region and
    the overall group, a narrow ``explode``) and one grouped exact selection finds all medians;
    each group's median is then divided by the overall one."""
    from ..functions.stats import exact_group_percentiles
    keys = F.array(F.struct(F.lit("industry").alias("kind"), F.col("industry").alias("key")),
                   F.struct(F.lit("region").alias("kind"), F.col("region").alias("key")),
                   F.struct(F.lit("overall").alias("kind"), F.lit("").alias("key")))
    long = quotes.select(F.explode(keys).alias("_k"), F.col(premium).alias("_p")).select(
        F.concat("_k.kind", F.lit("|"), "_k.key").alias("_g"), "_p")  # a null key is no group
    med = exact_group_percentiles(long, "_g", "_p", {"_median": 0.5})
    overall = med.where(F.col("_g") == "overall|").select(F.col("_median").alias("_overall"))
    parts = med.where(F.col("_g") != "overall|").crossJoin(F.broadcast(overall))
    return parts.select(F.split("_g", r"\|")[0].alias("kind"), F.split("_g", r"\|")[1].alias("key"),
                        round_even(F.col("_median") / F.col("_overall"), 3).alias("multiplier"))


def band_multipliers(quotes: DataFrame, premium: str = PREMIUM_COL) -> DataFrame:
    """PRC8: bins (0,3], (3,7], (7,15], (15,10000]; out-of-bin rows dropped; normalised to 4-7L
    (or to the median of the band medians if 4-7L is absent); missing bands 1.0.
    Band medians by grouped exact selection; the median of at most four band medians is a tiny aggregate."""
    from ..functions.stats import exact_group_percentiles, median
    sa = F.col("sum_assured_lakhs")
    band = (F.when((sa > 0) & (sa <= 3), "1-3L").when((sa > 3) & (sa <= 7), "4-7L")
             .when((sa > 7) & (sa <= 15), "8-15L").when((sa > 15) & (sa <= 10000), "15L+"))
    b = quotes.select(band.alias("band"), F.col(premium)).where(F.col("band").isNotNull())
    g = exact_group_percentiles(b, "band", premium, {"_m": 0.5})
    base = g.agg(F.coalesce(F.max(F.when(F.col("band") == "4-7L", F.col("_m"))), median("_m")).alias("_base"))
    spark = quotes.sparkSession
    labels = spark.createDataFrame([(b_, i) for i, b_ in enumerate(["1-3L", "4-7L", "8-15L", "15L+"])],
                                   "band string, position int")
    return (labels.join(g, "band", "left").crossJoin(F.broadcast(base))
                  .select("band", "position",
                          F.coalesce(round_even(F.col("_m") / F.col("_base"), 3), F.lit(1.0)).alias("multiplier")))


# Wellness playbook: driver -> (action, expected impact, mid HRS drop).
INTERVENTIONS = {
    "avg_daily_steps": ("Step-count challenge", "Expected HRS drop: 5–12 pts", 8.5),
    "smoker": ("Smoking cessation program", "Expected HRS drop: 8–15 pts", 11.5),
    "avg_sleep_hours": ("Sleep hygiene workshops", "Expected HRS drop: 3–6 pts", 4.5),
    "hypertension": ("BP screening camps", "Expected HRS drop: 6–10 pts", 8.0),
    "diabetic": ("Diabetes management program", "Expected HRS drop: 10–18 pts", 14.0),
    "bmi": ("Nutrition counseling + gym", "Expected HRS drop: 4–8 pts", 6.0),
    "visit_count": ("Preventive care incentives", "Expected HRS drop: 5–9 pts", 7.0),
    "avg_resting_hr": ("Cardio fitness program", "Expected HRS drop: 4–7 pts", 5.5),
    "health_composite": ("Comprehensive wellness bundle", "Expected HRS drop: 10–20 pts", 15.0),
    "activity_score": ("Workplace activity program", "Expected HRS drop: 6–10 pts", 8.0),
    "clinical_burden": ("Case management for high-users", "Expected HRS drop: 8–14 pts", 11.0),
    "chronic_count": ("Chronic disease management", "Expected HRS drop: 10–18 pts", 14.0),
}


def recommend_interventions(importance: DataFrame, premiums: DataFrame, group: str = "company_id",
                            premium: str = "adjusted") -> DataFrame:
    """PRC13: of the top-4 drivers, those with a playbook entry (original rank kept);
    savings = mid HRS drop / 100 x adjusted premium x 0.8.  The 12-row playbook is a literal."""
    spark = importance.sparkSession
    pb = spark.createDataFrame([(k, a, i, m) for k, (a, i, m) in INTERVENTIONS.items()],
                               "feature string, action string, impact string, hrs_mid double")
    top = importance.where(F.col("rank") <= 4)
    df = top.join(F.broadcast(pb), "feature", "inner").join(premiums.select(group, premium), group, "inner")
    return df.select(group, "rank", "feature", "action", "impact",
                     (F.col("hrs_mid") / 100 * F.col(premium) * 0.8).alias("estimated_savings"))
