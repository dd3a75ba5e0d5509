"""Registered queries: model fitting/evaluation (MOD*) and scoring/explanations (SCO4-SCO11)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import FEATURE_COLUMNS, TARGET_LOG
from ..operators import model as MD
from ..operators import scoring as S
from ..operators.features import engineer_features
from ..operators.harmonize import pivot_labs, population_defaults, to_feature_rows
from ..sources.fixtures import fixture
from .catalog_core import scored, snapshot
from .catalog_harmonize import LAB_ROWS_SQL, lab_snapshot
from .catalog_ingest import SCORING_RULES, reasons_sql
from .oracle_sql import (CORE_FIXTURES, FEATURES_CTES, SNAPSHOT_CTES, band_sql, importance_ctes, j_uniform, premium_sql, rnd,
                         scored_ctes, scorecard_sql, with_fixtures)
from .registry import register

_BASE = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes())


#: Trees per trial on the last rung of the registered search; with 50 trials on the first rung.
TUNE_ROUNDS = 36


def _features(spark, sf):
    """Scored per-employee features, materialised once (means, ranks and rows all read it)."""
    from ..session import materialize
    return materialize(MD.apply_scorecard(engineer_features(snapshot(spark, sf))), "features")


def _split(spark, sf):
    f = MD.quartile_strata(_features(spark, sf))
    return MD.stratified_split(f, "employee_key")


def _training_table(spark, sf):
    """The split feature table, materialised once in the shared checkpoint folder:
    cross-validation and fitting rescan it many times, and it cuts a long lineage."""
    from ..session import materialize
    return materialize(_split(spark, sf), "training")


_STRATA = _BASE + f"""
, qe AS (SELECT list_filter(list_distinct([quantile_cont(loss_ratio_log, 0.25), quantile_cont(loss_ratio_log, 0.5),
                               quantile_cont(loss_ratio_log, 0.75)]), lambda x: x > min(loss_ratio_log)) AS edges FROM or_pred),
s0 AS (SELECT p.*, len(list_filter(edges, lambda x: x < p.loss_ratio_log)) AS stratum,
              {j_uniform('p.employee_key', 'split')} AS draw FROM or_pred p CROSS JOIN qe),
sz AS (SELECT stratum, count(*)::HUGEINT AS n, (SELECT count(*)::HUGEINT FROM s0) AS total,
              (SELECT CAST(ceil(count(*) * 0.2e0) AS HUGEINT) FROM s0) AS test FROM s0 GROUP BY stratum),
sh AS (SELECT stratum, n * test // total AS base, n * test % total AS rest, test FROM sz),
sq AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= test - sum(base) OVER ()
                                   THEN 1 ELSE 0 END AS quota FROM sh),
sp AS (SELECT s0.* EXCLUDE (draw), row_number() OVER (PARTITION BY s0.stratum ORDER BY draw, employee_key) <= quota AS is_test
       FROM s0 JOIN sq ON sq.stratum = s0.stratum)"""


@register("mod1_2_strata_split", oracle=_STRATA + "\nSELECT employee_key, CAST(stratum AS INTEGER) AS stratum, is_test FROM sp")
def q_strata(spark, sf):
    """MOD1 + MOD2: target quartile strata (deduplicated edges) and the seeded 80/20 split, exact in every stratum."""
    return _split(spark, sf).select("employee_key", "stratum", "is_test")


@register("mod6_regression_metrics", oracle=_STRATA + """
, ym AS (SELECT is_test, avg(loss_ratio_log) AS ybar FROM sp GROUP BY is_test)
SELECT avg(abs(loss_ratio_log - log_pred)) AS mae, sqrt(avg((loss_ratio_log - log_pred) * (loss_ratio_log - log_pred))) AS rmse,
       1e0 - sum((loss_ratio_log - log_pred) * (loss_ratio_log - log_pred)) / sum((loss_ratio_log - ybar) * (loss_ratio_log - ybar)) AS r2,
       count(*) AS rows, CASE WHEN sp.is_test THEN 'test' ELSE 'train' END AS split
FROM sp JOIN ym ON ym.is_test = sp.is_test GROUP BY sp.is_test""", floats=["mae", "rmse", "r2"])
def q_metrics(spark, sf):
    """MOD6: MAE / RMSE / R^2 of the scorecard on the train and test splits."""
    return MD.regression_metrics(_split(spark, sf))


@register("mod7_sanity_sample", oracle=_STRATA + """
, sc AS (SELECT s.*, round_even(CASE WHEN c.p95 - c.p05 IS NULL OR isnan(c.p95 - c.p05) OR abs(c.p95 - c.p05) < 1e-12 THEN 50e0
               ELSE least(greatest((s.log_pred - c.p05) / (c.p95 - c.p05) * 100e0, 0e0), 100e0) END, 1) AS hrs
         FROM sp s CROSS JOIN or_scorer c)
SELECT employee_key, exp(log_pred) - 1 AS predicted_lr, loss_ratio AS actual_lr, hrs,
       CASE WHEN hrs < 30 THEN 'Low' WHEN hrs < 60 THEN 'Moderate' WHEN hrs < 80 THEN 'High' ELSE 'Critical' END AS risk_band
FROM sc WHERE is_test ORDER BY employee_key LIMIT 5""", floats=["predicted_lr", "actual_lr", "hrs"])
def q_sanity(spark, sf):
    """MOD7: five test employees with predicted vs actual LR, HRS and band."""
    d = _split(spark, sf)
    return MD.sanity_sample(S.score_hrs(d, S.fit_scorer(d)), "employee_key")


@register("mod3_tune")
def q_tune(spark, sf):
    """MOD3: Parzen search with rungs over the training split, 50 trials and 5 folds."""
    train = _lab_training_table(spark, sf).where(~F.col("is_test"))
    _, trials = MD.tune(train, "employee_key", rounds=TUNE_ROUNDS)
    return trials


def _lab_training_table(spark, sf):
    """The split feature table with lab flags, on which the boosted models are fitted: the columns they read are stored
    once, and a row's stratum and side follow from the stored edges and cuts."""
    from ..session import materialize
    rows = engineer_features(lab_snapshot(spark, sf)).select("employee_key", "company_id", *FEATURE_COLUMNS, TARGET_LOG)
    return MD.stratified_split(MD.quartile_strata(materialize(rows, "lab-features")), "employee_key")


#: Fitted challengers of this process, as plain data: a model is an artifact that several queries use.
_CHALLENGERS: dict = {}


def _challenger(spark, sf, monotone=True):
    """The split table, the boosted challenger fitted on its training rows, and its validation errors."""
    d = _lab_training_table(spark, sf)
    name = spark.sparkContext.applicationId, sf, monotone
    if name not in _CHALLENGERS:
        _CHALLENGERS[name] = MD.fit_gbt(d.where(~F.col("is_test")), "employee_key", {"maxDepth": 3, "stepSize": 0.2},
                                        monotone=monotone)
    return d, *_CHALLENGERS[name]


@register("mod4_fit_gbt")
def q_fit_gbt(spark, sf):
    """MOD4: boosted challenger grown with patience 50 on a keyed 10% validation slice; test predictions."""
    d, model, _ = _challenger(spark, sf)
    return model.score(d.where(F.col("is_test")), "log_pred_gbt").select("employee_key", "log_pred_gbt", "loss_ratio_log")


@register("mod4_validation_curve")
def q_validation_curve(spark, sf):
    """MOD4: validation error of every prefix of the challenger, and which one was kept."""
    _, model, errors = _challenger(spark, sf)
    return spark.createDataFrame([(n, float(e), n == len(model.trees)) for n, e in enumerate(errors)],
                                 "trees int, mae double, kept boolean")


@register("mod5_fit_scorecard")
def q_fit_scorecard(spark, sf):
    """MOD5: sign-constrained linear scorecard fitted on the training split, with its sign audit."""
    d = _training_table(spark, sf)
    sc = MD.fit_scorecard(d.where(~F.col("is_test")))
    return MD.scorecard_audit(sc, spark)


@register("mod5_monotone_audit_gbt")
def q_monotone(spark, sf):
    """MOD5: monotone audit (+1 perturbation per constrained feature) of the challenger and of the same trees
    without projection, with the test error of both."""
    from ..operators.trees import project_monotone
    d, free, _ = _challenger(spark, sf, monotone=False)
    test = d.where(F.col("is_test"))
    out = None
    for name, model in (("free", free), ("monotone", project_monotone(free))):
        mae = model.score(test).agg(F.avg(F.abs(F.col("loss_ratio_log") - F.col("prediction"))).alias("test_mae"))
        rows = MD.monotone_audit(model, test).crossJoin(F.broadcast(mae)).select(F.lit(name).alias("model"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("sco8_tree_drivers")
def q_tree_drivers(spark, sf):
    """SCO8: top-5 drivers per test employee by the Shapley values of the boosted challenger."""
    d, model, _ = _challenger(spark, sf)
    return S.tree_drivers(d.where(F.col("is_test")), "employee_key", model)


@register("sco9_tree_importance")
def q_tree_importance(spark, sf):
    """SCO9: top-5 features per company by mean |Shapley value| of the boosted challenger."""
    d, model, _ = _challenger(spark, sf)
    return S.tree_importance(d, model)


@register("mod8_run_record", oracle=_STRATA + """
, ym AS (SELECT is_test, avg(loss_ratio_log) AS ybar FROM sp GROUP BY is_test),
mt AS (SELECT sp.is_test, avg(abs(loss_ratio_log - log_pred)) AS mae,
              sqrt(avg((loss_ratio_log - log_pred) * (loss_ratio_log - log_pred))) AS rmse,
              1e0 - sum((loss_ratio_log - log_pred) * (loss_ratio_log - log_pred)) / sum((loss_ratio_log - ybar) * (loss_ratio_log - ybar)) AS r2
       FROM sp JOIN ym ON ym.is_test = sp.is_test GROUP BY sp.is_test)
SELECT 31 AS n_features, 'local' AS dataset_mode, a.mae AS train_mae, a.rmse AS train_rmse, a.r2 AS train_r2,
       b.mae AS test_mae, b.rmse AS test_rmse, b.r2 AS test_r2, p05, p95,
       '{"local":' || (SELECT count(*) FROM sp) || '}' AS rows_per_source, 1 AS run
FROM (SELECT * FROM mt WHERE NOT is_test) a, (SELECT * FROM mt WHERE is_test) b,
     (SELECT quantile_cont(log_pred, 0.05) AS p05, quantile_cont(log_pred, 0.95) AS p95 FROM sp WHERE NOT is_test)""",
          floats=["train_mae", "train_rmse", "train_r2", "test_mae", "test_rmse", "test_r2", "p05", "p95"])
def q_run_record(spark, sf):
    """MOD8: the run record appended to a runs table: feature count, mode, rows per source, metrics, calibration bounds."""
    import uuid

    from ..session import scratch_path
    d = _training_table(spark, sf)
    metrics = MD.regression_metrics(d)
    scorer = S.fit_scorer(d.where(~F.col("is_test")))
    rows = d.groupBy(F.lit("local").alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    runs = MD.append_run(MD.run_record(spark, "local", metrics, scorer, rows), scratch_path(spark, f"runs-{uuid.uuid4().hex}"))
    return runs.drop("recorded_at")


# ---- scoring ------------------------------------------------------------------------------------

@register("sco4_scorer_state", oracle=_BASE + "\nSELECT p05, p95, true AS fitted FROM or_scorer", floats=["p05", "p95"])
def q_scorer_state(spark, sf):
    """SCO4: the scorer's state row (p05, p95, fitted)."""
    _, scorer = scored(spark, sf)
    return S.scorer_state(scorer)


@register("sco4_restore_scorer", oracle=_BASE + "\nSELECT employee_key, hrs FROM or_scored", floats=["hrs"])
def q_restore_scorer(spark, sf):
    """SCO4: the scorer's state saved, read back, restored and used to score everyone."""
    import uuid

    from ..session import scratch_path
    f, path = _features(spark, sf), scratch_path(spark, f"scorer-{uuid.uuid4().hex}")
    S.scorer_state(S.fit_scorer(f, materialized=True)).write.parquet(path)
    return S.score_hrs(f, S.restore_scorer(spark.read.parquet(path))).select("employee_key", "hrs")


def _drivers_sql():
    from ..operators.model import DEFAULT_SCORECARD as M
    feats = FEATURE_COLUMNS
    means = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in feats)
    rows = " UNION ALL ".join(
        f"SELECT employee_key, {i} AS i, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, "
        f"CAST({float(M.weights.get(f, 0.0))!r} AS DOUBLE) * (CAST({f} AS DOUBLE) - m_{f}) AS shap_value FROM or_pred CROSS JOIN dm"
        for i, f in enumerate(feats))
    return f"""
, dm AS (SELECT {means} FROM or_pred),
dl AS ({rows}),
dr AS (SELECT *, row_number() OVER (PARTITION BY employee_key ORDER BY abs(shap_value) DESC, i) AS rank FROM dl)"""


_DRIVERS = _BASE + _drivers_sql()


@register("sco5_predict_employees", oracle=_DRIVERS + """
, h AS (SELECT p.employee_key, p.company_id, p.log_pred,
               CASE WHEN s.p95 - s.p05 IS NULL OR isnan(s.p95 - s.p05) OR abs(s.p95 - s.p05) < 1e-12 THEN 50e0
                    ELSE least(greatest((p.log_pred - s.p05) / (s.p95 - s.p05) * 100e0, 0e0), 100e0) END AS h
        FROM or_pred p CROSS JOIN or_scorer s)
SELECT h.employee_key, company_id, CAST(round_even(CAST(CAST(exp(log_pred) - 1 AS VARCHAR) AS DECIMAL(38,20)), 4) AS DOUBLE) AS predicted_loss_ratio,
       CAST(round_even(CAST(CAST(h AS VARCHAR) AS DECIMAL(38,20)), 1) AS DOUBLE) AS health_risk_score,
       CASE WHEN h < 30 THEN 'Low' WHEN h < 60 THEN 'Moderate' WHEN h < 80 THEN 'High' ELSE 'Critical' END AS risk_band,
       CAST(rank AS INTEGER) AS rank, feature, value, shap_value,
       CASE WHEN shap_value > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction
FROM h JOIN dr ON dr.employee_key = h.employee_key WHERE rank <= 5""",
          floats=["predicted_loss_ratio", "health_risk_score", "value", "shap_value"])
def q_predict_employees(spark, sf):
    """SCO5: per-employee predicted LR (4 dp), HRS (1 dp), band from the unrounded HRS and top-5 drivers, a row per driver."""
    from ..operators.model import DEFAULT_SCORECARD
    f = _features(spark, sf)
    p = S.predict_employees(f, S.fit_scorer(f, materialized=True), weights=DEFAULT_SCORECARD.weights, means=S.feature_means(f))
    return S.driver_rows(p, "employee_key", "company_id", "predicted_loss_ratio", "health_risk_score", "risk_band")


_IMPORTANCE = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes(), importance_ctes())


@register("sco6_company_result", oracle=_IMPORTANCE + """
SELECT c.*, CAST(i.rank AS INTEGER) AS rank, i.feature, i.importance
FROM or_companies c JOIN or_importance i ON i.company_id = c.company_id""",
          floats=["mean_loss_ratio", "mean_hrs", "low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct",
                  "importance"])
def q_company_result(spark, sf):
    """SCO6 + SCO7 + SCO9: per-company result with its top-5 drivers, a row per driver."""
    from ..operators.model import DEFAULT_SCORECARD
    f = _features(spark, sf)
    companies = S.predict_companies(S.score_hrs(f, S.fit_scorer(f, materialized=True)))
    r = S.company_result(companies, S.global_importance(f, DEFAULT_SCORECARD.weights, S.feature_means(f), "company_id"))
    return r.select(*companies.columns, F.explode("top_risk_drivers").alias("_d")).select(
        *companies.columns, F.col("_d.rank").cast("int").alias("rank"), "_d.feature", "_d.importance")


@register("sco6_hrs_distribution", oracle=_BASE + """
, k AS (SELECT company_id, hrs, row_number() OVER (PARTITION BY company_id ORDER BY hrs) - 1 AS r FROM or_scored)
SELECT company_id, r // 10000 AS chunk, count(*) AS scores, string_agg(printf('%.1f', hrs), ',' ORDER BY hrs) AS hrs_distribution
FROM k GROUP BY company_id, r // 10000""")
def q_hrs_distribution(spark, sf):
    """SCO6: all scores of every company in ascending order, 10,000 a row, as text."""
    f = _features(spark, sf)
    d = S.hrs_distribution(S.score_hrs(f, S.fit_scorer(f, materialized=True)))
    return d.select("company_id", "chunk", F.size("hrs_distribution").cast("long").alias("scores"),
                    F.array_join(F.transform("hrs_distribution", lambda h: F.format_string("%.1f", h)), ",").alias("hrs_distribution"))


@register("sco8_top_drivers", oracle=_DRIVERS + """
SELECT employee_key, CAST(rank AS INTEGER) AS rank, feature, value, shap_value,
       CASE WHEN shap_value > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction FROM dr WHERE rank <= 5""",
          floats=["value", "shap_value"])
def q_top_drivers(spark, sf):
    """SCO8: top-5 drivers per employee by |exact linear Shapley contribution| (ranked inside each row)."""
    f = _features(spark, sf)
    from ..operators.model import DEFAULT_SCORECARD
    return S.top_drivers(f, "employee_key", DEFAULT_SCORECARD.weights, S.feature_means(f))


@register("sco9_global_importance", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes(),
                                                         importance_ctes()) + """
SELECT company_id, feature, importance, CAST(rank AS INTEGER) AS rank FROM or_importance""", floats=["importance"])
def q_importance(spark, sf):
    """SCO9: top-5 features per company by mean |contribution| (aggregated wide, then unpivoted)."""
    f = _features(spark, sf)
    from ..operators.model import DEFAULT_SCORECARD
    return S.global_importance(f, DEFAULT_SCORECARD.weights, S.feature_means(f), "company_id") \
        .withColumn("rank", F.col("rank").cast("int"))


def _text_sql():
    parts = []
    for feat, fmt, dec in S.DRIVER_TEXT:
        if dec is None:
            parts.append(f"WHEN feature = '{feat}' THEN '{fmt.replace('%%', '%')}'")
        else:
            f2 = fmt.replace("%s", f"%.{dec}f")
            parts.append(f"WHEN feature = '{feat}' THEN printf('{f2}', "
                         f"CAST(round_even(CAST(CAST(value AS VARCHAR) AS DECIMAL(38,20)), {dec}) AS DOUBLE))")
    return "CASE " + " ".join(parts) + " ELSE feature END"


@register("sco10_driver_text", oracle=_DRIVERS + f"""
SELECT employee_key, CAST(rank AS INTEGER) AS rank, feature,
       {_text_sql()} || ' ' || CASE WHEN shap_value > 0 THEN 'increases risk' ELSE 'reduces risk' END AS explanation
FROM dr WHERE rank <= 5""")
def q_driver_text(spark, sf):
    """SCO10: plain-language text for each top driver."""
    f = _features(spark, sf)
    from ..operators.model import DEFAULT_SCORECARD
    d = S.top_drivers(f, "employee_key", DEFAULT_SCORECARD.weights, S.feature_means(f))
    return S.driver_text(d).select("employee_key", "rank", "feature", "explanation")


def _up(sql):
    """The feature CTEs read from the upload's rows instead of the snapshot."""
    for name in ("or_snapshot", "or_f1", "or_features"):
        sql = sql.replace(name, "up_" + name[3:])
    return sql.strip()


_UPLOAD_SQL = LAB_ROWS_SQL + ", " + FEATURES_CTES.strip() + ", " + scored_ctes().strip() + f"""
, up_snapshot AS (
  SELECT *, employee_id AS employee_key, CAST(NULL AS VARCHAR) AS company_id, CAST(NULL AS DOUBLE) AS total_claims,
         CAST(NULL AS DOUBLE) AS premium_share, CAST(NULL AS DOUBLE) AS loss_ratio, 0 AS high_risk FROM lab_rows),
""" + _up(FEATURES_CTES) + f""",
up_why AS (SELECT employee_id, {reasons_sql(SCORING_RULES)} AS errors FROM lab_rows),
up_pred AS (SELECT employee_key AS employee_id, {scorecard_sql()} AS log_pred FROM up_features),
up_hrs AS (SELECT p.*, CASE WHEN s.p95 - s.p05 IS NULL OR isnan(s.p95 - s.p05) OR abs(s.p95 - s.p05) < 1e-12 THEN 50e0
                            ELSE least(greatest((p.log_pred - s.p05) / (s.p95 - s.p05) * 100e0, 0e0), 100e0) END AS h
           FROM up_pred p CROSS JOIN or_scorer s),
up_rows AS (
  SELECT r.employee_id, r.age, r.gender, greatest(15e0, least(50e0, r.bmi)) AS bmi, r.smoker, r.diabetic, r.hypertension, r.job_category,
         CASE WHEN len(errors) = 0 THEN {rnd('h', 1)} END AS hrs,
         CASE WHEN len(errors) = 0 THEN {rnd('exp(log_pred) - 1e0', 4)} END AS loss_ratio,
         CASE WHEN len(errors) = 0 THEN {band_sql('h')} END AS risk_band, array_to_string(errors, '; ') AS reasons
  FROM lab_rows r JOIN up_why w ON w.employee_id = r.employee_id JOIN up_hrs u ON u.employee_id = r.employee_id)"""
_UP_PREMIUM = premium_sql("5000000e0", "m")


def _upload_rows(spark, sf):
    requests = to_feature_rows(pivot_labs(fixture(spark, sf, "fx_lab_results")), population_defaults(snapshot(spark, sf)))
    _, scorer = scored(spark, sf)
    return S.score_upload(requests, MD.DEFAULT_SCORECARD, scorer)


@register("sco11_upload_rows", oracle=_UPLOAD_SQL + "\nSELECT * FROM up_rows", floats=["bmi", "hrs", "loss_ratio"])
def q_upload_rows(spark, sf):
    """SCO11 (+HRM18, ING11): every row of a lab upload with its HRS, loss ratio and band, or the reasons it is rejected."""
    return _upload_rows(spark, sf).withColumn("reasons", F.array_join("errors", "; ")).drop("errors")


@register("sco11_score_upload", oracle=_UPLOAD_SQL + f"""
, up_sum AS (SELECT count(*) AS employee_count, avg(hrs) AS m, avg(loss_ratio) AS lr,
                    {", ".join(f"avg(CASE WHEN risk_band = '{b}' THEN 1e0 ELSE 0e0 END) * 100e0 AS {b.lower()}" for b in ("Low", "Moderate", "High", "Critical"))}
             FROM up_rows WHERE reasons = '')
SELECT employee_count, {rnd('m', 1)} AS mean_hrs, {rnd('lr', 4)} AS mean_loss_ratio, {band_sql('m')} AS risk_band,
       {rnd('low', 1)} AS low_risk_pct, {rnd('moderate', 1)} AS moderate_risk_pct, {rnd('high', 1)} AS high_risk_pct,
       {rnd('critical', 1)} AS critical_risk_pct, 5000000e0 AS base_premium, {_UP_PREMIUM['adjusted_premium']} AS adjusted_premium,
       {_UP_PREMIUM['adjustment_pct']} AS adjustment_pct, {_UP_PREMIUM['zone']} AS zone FROM up_sum""",
          floats=["mean_hrs", "mean_loss_ratio", "low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct",
                  "base_premium", "adjusted_premium", "adjustment_pct"])
def q_score_upload(spark, sf):
    """SCO11: summary of a scored lab upload: mean HRS and loss ratio, band mix, band and premium for a 5,000,000 base."""
    return S.upload_summary(_upload_rows(spark, sf), 5_000_000.0).drop("recommendation")
