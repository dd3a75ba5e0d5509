"""Portfolio and cohort analytics (PRT1-PRT17): joins, sorts, top-k, histograms."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import round_even
from .pricing import premium_columns


def portfolio(companies: DataFrame, company_scores: DataFrame) -> DataFrame:
    """PRT3: one row per company: head-count, mean HRS, band, base and adjusted premium, pct, zone.

    One set-based job (the reference makes one call per company): company scores
    JOIN the company dimension, then the premium expression on each row.
    Premium uses the plain HRS rule (multiplier 1.0), like the premium endpoint.
    """
    df = company_scores.join(companies.select("company_id", "company_name", "industry", "base_premium"),
                             "company_id", "inner")
    p = premium_columns("base_premium", "mean_hrs")
    return df.select(
        "company_id", "company_name", "industry",
        F.col("employee_count").alias("employees"), "mean_hrs", "risk_band",
        F.col("base_premium").cast("double").alias("base_premium"),
        p["adjusted_premium"].alias("adjusted"), p["adjustment_pct"].alias("adjustment_pct"),
        p["zone"].alias("zone"),
    )


def apply_row_policy(df: DataFrame, role: str, company_id: str | None = None) -> DataFrame:
    """ING19: row-level access for one principal.

    underwriter sees every row; hr_admin sees only its own company; an hr_admin
    without a company, or any other role, sees nothing.  A pure filter.
    """
    if role == "underwriter":
        return df
    if role == "hr_admin" and company_id:
        return df.where(F.col("company_id") == F.lit(company_id))
    return df.where(F.lit(False))


def access_decisions(requests: DataFrame, principals: DataFrame) -> DataFrame:
    """ING19: each request (principal, company_id) with the role it is judged by, ``allowed`` and ``reason``.

    Underwriters may see every company, an hr_admin the one it is bound to; an hr_admin without a company,
    any other role and a principal that is not in the table are denied.  A null company stands for the list of
    all visible companies, which everyone with a role may ask for who can see any.
    """
    p = principals.select("principal", "role", F.col("company_id").alias("_own"))
    d = requests.join(p, "principal", "left")
    hr, own = F.col("role") == "hr_admin", F.col("_own")
    reason = (F.when(F.col("role").isNull(), "unknown principal")
              .when(F.col("role") == "underwriter", F.lit(None))
              .when(~hr, "role without access")
              .when(own.isNull(), "hr_admin account has no company_id configured")
              .when(F.col("company_id").isNotNull() & (F.col("company_id") != own), "Access denied for this company"))
    return d.select(*requests.columns, "role", reason.isNull().alias("allowed"), reason.alias("reason"))


def visible_rows(df: DataFrame, principals: DataFrame, principal: str) -> DataFrame:
    """ING19: the rows of ``df`` that one principal of the table may see; none if it is denied or unknown."""
    mine = principals.where(F.col("principal") == principal).agg(F.max("role").alias("_role"), F.max("company_id").alias("_own"))
    allowed = (F.col("_role") == "underwriter") | ((F.col("_role") == "hr_admin") & (F.col("company_id") == F.col("_own")))
    return df.crossJoin(F.broadcast(mine)).where(allowed).select(*df.columns)


def list_companies(companies: DataFrame, role: str, company_id: str | None = None) -> DataFrame:
    """PRT1: companies visible to the principal, ordered by name."""
    return apply_row_policy(companies, role, company_id).orderBy("company_name", "company_id")


# The 16 employee columns of the company-employees listing.
COMPANY_EMPLOYEE_COLUMNS = [
    "employee_key", "age", "gender", "bmi", "smoker", "diabetic", "hypertension", "chronic_count",
    "job_category", "avg_daily_steps", "avg_resting_hr", "avg_sleep_hours", "visit_count",
    "hospitalized_count", "loss_ratio", "high_risk",
]


def company_employees(snapshot: DataFrame, employees: DataFrame, company_id: str | None = None) -> DataFrame:
    """PRT2: snapshot JOIN roster on the person key (roster's job category wins), 16 columns."""
    s = snapshot.drop("job_category", "gender")
    e = employees.select("employee_key", "job_category", "gender")
    df = s.join(e, "employee_key", "inner")
    if company_id is not None:
        df = df.where(F.col("company_id") == company_id)
    return df.select("company_id", *COMPANY_EMPLOYEE_COLUMNS)


def portfolio_kpis(pf: DataFrame) -> DataFrame:
    """PRT4: companies, need-review count, head-count, mean HRS and delta vs 50, premium totals."""
    return pf.agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if(F.col("risk_band").isin("High", "Critical")).alias("need_review"),
        F.sum("employees").alias("total_employees"),
        F.avg("mean_hrs").alias("avg_hrs"),
        (F.avg("mean_hrs") - 50.0).alias("hrs_vs_benchmark"),
        F.sum("adjusted").alias("adjusted_total"),
        (F.sum("adjusted") - F.sum("base_premium")).alias("premium_delta"),
    )


def _alert(ord_, on, severity, message, band):
    return F.struct(F.lit(ord_).alias("ord"), on.alias("on"), F.lit(severity).alias("severity"),
                    message.alias("message"), F.lit(band).alias("band"))


def portfolio_alerts(pf: DataFrame, max_alerts: int = 4) -> DataFrame:
    """PRT5: portfolio alerts in fixed order, at most four.

    Any Critical (first two names by name, "+n more"); more than one High;
    premium adjustment > 10%; mean HRS > 50; any Low.  Two one-row aggregates
    (the second finds the second critical name, which may equal the first), no list collection.
    """
    crit = F.col("risk_band") == "Critical"
    a = pf.agg(
        F.count_if(crit).alias("n_crit"),
        F.min(F.when(crit, F.col("company_name"))).alias("name1"),
        F.count_if(F.col("risk_band") == "High").alias("n_high"),
        F.count_if(F.col("adjustment_pct") > 10).alias("n_adj"),
        F.avg("mean_hrs").alias("avg_hrs"),
        F.count_if(F.col("risk_band") == "Low").alias("n_low"),
    )
    first = crit & (F.col("company_name") == F.col("name1"))
    b = pf.crossJoin(F.broadcast(a.select("name1"))).agg(
        F.when(F.count_if(first) > 1, F.min(F.when(first, F.col("company_name"))))
         .otherwise(F.min(F.when(crit & (F.col("company_name") > F.col("name1")), F.col("company_name")))).alias("name2"))
    s = a.crossJoin(F.broadcast(b))
    names = F.when(F.col("name2").isNull(), F.col("name1")).otherwise(F.concat_ws(", ", "name1", "name2"))
    suffix = F.when(F.col("n_crit") > 2, F.concat(F.lit(" +"), (F.col("n_crit") - 2).cast("string"), F.lit(" more"))) \
        .otherwise(F.lit(""))
    alerts = F.array(
        _alert(1, F.col("n_crit") > 0, "high",
               F.concat(names, suffix, F.lit(" — immediate underwriting review required")), "Critical"),
        _alert(2, F.col("n_high") > 1, "med",
               F.concat(F.col("n_high").cast("string"), F.lit(" companies in High risk band — elevated claims exposure")),
               "High"),
        _alert(3, F.col("n_adj") > 0, "info",
               F.concat(F.col("n_adj").cast("string"), F.lit(" companies flagged for >10% premium adjustment at renewal")),
               "Moderate"),
        _alert(4, F.col("avg_hrs") > 50, "info",
               F.concat(F.lit("Portfolio avg HRS "), F.format_string("%.1f", round_even(F.col("avg_hrs"), 1)),
                        F.lit(" — exceeds 50-point industry benchmark")), "Moderate"),
        _alert(5, F.col("n_low") > 0, "ok",
               F.concat(F.col("n_low").cast("string"),
                        F.lit(" companies in Low risk band — favourable renewal terms available")), "Low"),
    )
    on = s.select(F.inline(alerts)).where(F.col("on"))
    w = Window.orderBy("ord")  # at most five rows
    return (on.withColumn("position", F.row_number().over(w)).where(F.col("position") <= max_alerts)
              .select("position", "severity", "message", "band"))


def filter_portfolio(pf: DataFrame, band: str | None = None, search: str | None = None,
                     code: str = "INR") -> DataFrame:
    """PRT6: band filter, case-insensitive name search, FX projection, sorted by HRS desc."""
    from ..functions.constants import CURRENCIES
    df = pf
    if band and band != "All":
        df = df.where(F.col("risk_band") == band)
    if search:
        df = df.where(F.lower(F.col("company_name")).contains(search.lower()))
    rate = F.lit(CURRENCIES[code][2])
    return (df.withColumn("base_premium_fx", F.col("base_premium") * rate)
              .withColumn("adjusted_fx", F.col("adjusted") * rate)
              .withColumn("currency", F.lit(code))
              .orderBy(F.desc("mean_hrs"), "company_id"))


def spotlight(pf: DataFrame) -> DataFrame:
    """PRT7: the highest-HRS company (ties by company id); a TakeOrdered top-1."""
    return pf.orderBy(F.desc("mean_hrs"), "company_id").limit(1)


def hrs_histogram(scored: DataFrame, group: str | None = "company_id", hrs: str = "hrs",
                  bins: int = 20) -> DataFrame:
    """PRT8: HRS histogram with fixed 5-wide bins on 0..100 (bin 19 includes 100), empty bins as 0.

    Counts are a partial+final aggregate on (group, bin); the zero bins come from
    exploding ``sequence(0, bins-1)`` on the distinct groups (narrow), then a
    left join of the counts.
    """
    width = 100.0 / bins
    keys = [group] if group else []
    b = F.least(F.floor(F.col(hrs) / width), F.lit(bins - 1)).cast("int")
    counts = scored.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("employees"))
    base = (scored.select(*keys).distinct() if keys else scored.sparkSession.range(1).select())
    grid = base.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (grid.join(counts, keys + ["bin"], "left")
                .select(*keys, "bin", (F.col("bin") * width).alias("bin_lo"), ((F.col("bin") + 1) * width).alias("bin_hi"),
                        F.coalesce("employees", F.lit(0)).alias("employees")))


def industry_profile(pf: DataFrame) -> DataFrame:
    """PRT9: per industry mean HRS, employees and company count, highest HRS first."""
    return (pf.groupBy("industry").agg(F.avg("mean_hrs").alias("mean_hrs"),
                                       F.sum("employees").alias("employees"),
                                       F.count(F.lit(1)).alias("companies"))
              .orderBy(F.desc("mean_hrs"), "industry"))


def workstyle(employees: DataFrame, group: str = "company_id") -> DataFrame:
    """PRT10: per job category: count, mean LR capped at 1.0, percent, colour tier (.30/.60/.80)."""
    a = employees.where(F.col("job_category").isin("desk", "field", "manual")).groupBy(group, "job_category").agg(
        F.count(F.lit(1)).alias("employees"), F.avg("loss_ratio").alias("_lr"))
    score = F.least(F.col("_lr"), F.lit(1.0))
    # Tier colours
    colour = (F.when(score >= 0.80, "#ef4444").when(score >= 0.60, "#f97316")
               .when(score >= 0.30, "#eab308").otherwise("#22c55e"))
    return a.select(group, "job_category", "employees", score.alias("score"),
                    round_even(score * 100, 0).cast("int").alias("pct"), colour.alias("colour"))


def band_headcounts(company_risk: DataFrame, group: str = "company_id") -> DataFrame:
    """PRT11: head-count per band = int(employee_count x pct / 100) (truncation)."""
    cols = [("Low", "low_risk_pct"), ("Moderate", "moderate_risk_pct"), ("High", "high_risk_pct"),
            ("Critical", "critical_risk_pct")]
    return company_risk.select(group, *[F.floor(F.col("employee_count") * F.col(p) / 100.0).cast("int").alias(b)
                                        for b, p in cols])


def driver_shares(importance: DataFrame, group: str = "company_id", n: int = 5) -> DataFrame:
    """PRT12: driver bars: importance as a percent of the group's top importance (top n).

    The input has at most n rows per group (SCO9), so the window is tiny.
    """
    w = Window.partitionBy(group)
    top = F.max("importance").over(w)
    pct = F.when(top > 0, round_even(F.col("importance") / top * 100, 0)).otherwise(F.lit(0.0)).cast("int")
    return importance.where(F.col("rank") <= n).select(group, "rank", "feature", "importance", pct.alias("pct_of_max"))


def workforce_metrics(employees: DataFrame, group: str = "company_id") -> DataFrame:
    """PRT13: mean steps, mean resting HR, smoker %, share with at least one chronic condition."""
    return employees.groupBy(group).agg(
        F.avg("avg_daily_steps").alias("avg_daily_steps"),
        F.avg("avg_resting_hr").alias("avg_resting_hr"),
        (F.sum("smoker") / F.count(F.lit(1)) * 100).alias("smoker_pct"),
        (F.count_if(F.col("chronic_count") > 0) / F.count(F.lit(1)) * 100).alias("chronic_pct"),
    )


def cohort_points(employees: DataFrame, group: str = "company_id") -> DataFrame:
    """PRT14: the age x loss ratio x chronic cohort, rolled up to (age decade, chronic count).

    The reference plots one point per employee; at scale we emit the cohort
    cells (count, mean LR) so the output grows with cohorts, not people.
    """
    decade = (F.floor(F.col("age") / 10) * 10).cast("int")
    return employees.groupBy(group, decade.alias("age_decade"), "chronic_count").agg(
        F.count(F.lit(1)).alias("employees"), F.avg("loss_ratio").alias("mean_loss_ratio"),
        F.min("age").alias("min_age"), F.max("age").alias("max_age"))


def cohort_rows(employees: DataFrame, group: str = "company_id", key: str = "employee_key") -> DataFrame:
    """PRT14: the cohort's points themselves, one row per person: age, loss ratio and chronic count."""
    return employees.select(group, key, "age", "loss_ratio", "chronic_count")


def band_distribution(company_risk: DataFrame, group: str = "company_id") -> DataFrame:
    """PRT15: band mix in long form, zero bands dropped."""
    long = company_risk.select(group, "low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct") \
        .unpivot([group], ["low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct"], "band", "pct")
    name = (F.when(F.col("band") == "low_risk_pct", "Low").when(F.col("band") == "moderate_risk_pct", "Moderate")
             .when(F.col("band") == "high_risk_pct", "High").otherwise("Critical"))
    return long.where(F.col("pct") > 0).select(group, name.alias("band"), "pct")


def scored_roster(scored: DataFrame, band: str | None = None, hrs: str = "hrs") -> DataFrame:
    """PRT16: upload roster listing: optional band filter, highest HRS first."""
    df = scored if not band or band == "All" else scored.where(F.col("risk_band") == band)
    return df.orderBy(F.desc(hrs), *[c for c in ("employee_id", "employee_key") if c in scored.columns][:1])


def report_rows(pf: DataFrame, company_risk: DataFrame, importance: DataFrame, code: str = "INR",
                group: str = "company_id") -> DataFrame:
    """PRT17: one underwriting-report record per company: profile, risk, premium in currency, drivers.

    The drivers list holds at most 5 entries per company (SCO9 output), so the
    ``collect_list`` is bounded.
    """
    from ..functions.constants import CURRENCIES
    rate = F.lit(CURRENCIES[code][2])
    drivers = importance.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("rank", "feature", "importance"))).alias("drivers"))
    r = company_risk.select(group, "mean_loss_ratio", "low_risk_pct", "moderate_risk_pct", "high_risk_pct",
                            "critical_risk_pct")
    df = pf.join(r, group, "inner").join(drivers, group, "left")
    return df.select(
        group,
        F.struct("company_name", "industry", "employees").alias("profile"),
        F.struct("mean_hrs", "risk_band", "mean_loss_ratio", "low_risk_pct", "moderate_risk_pct",
                 "high_risk_pct", "critical_risk_pct").alias("risk"),
        F.struct(F.lit(code).alias("currency"), (F.col("base_premium") * rate).alias("base"),
                 (F.col("adjusted") * rate).alias("adjusted"), "adjustment_pct", "zone").alias("premium"),
        "drivers")
