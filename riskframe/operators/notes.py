"""Clinical-note parsing (MAP9) and note -> feature rows (MAP10).

Each note is parsed with JVM regular expressions only (``regexp_extract``,
``regexp_count``, ``rlike``); no Python runs per row.  Patterns are the
reference's, written for Java: ``(?i)`` case folding, ``(?d)`` so ``.`` only
stops at ``\\n`` (as in Python), and each condition's alternatives joined into
one pattern so every pattern is evaluated once per note.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp
from .mappers import _Noise, SEED

# Note patterns (Python syntax, as in the reference).
AGE_PATTERNS = [
    r"(\d{1,3})[- ]year[s]?[- ]old",
    r"\bAge:\s*(\d{1,3})",
    r"\bage[d]?\s+(\d{1,3})\b",
    r"\b(\d{1,3})[- ]yo\b",
]
AGE_LITERALS = ["year", "age", "age", "yo"]  # each occurs in every match of its pattern
FEMALE_PATTERN = r"\b(female|woman|women|she\b|her\b)"
MALE_PATTERN = r"\b(male|man\b|men\b|he\b|his\b)"
BMI_PATTERN = r"\bBMI\s*(?:of\s*|=\s*|:\s*)?(\d{1,2}(?:\.\d)?)\b"
CONDITIONS = {
    "smoker": [r"\bsmok(?:er|ing|ed)\b", r"\bcurrent smoker\b", r"\btobacco\b"],
    "diabetic": [r"\bdiabet(?:es|ic|ics)\b", r"\bDM\b", r"\binsulin[- ]dependent\b", r"\bT2DM\b", r"\bT1DM\b"],
    "hypertension": [r"\bhypertension\b", r"\bhigh blood pressure\b", r"\bHTN\b"],
    "cancer": [r"\bcancer\b", r"\bmalignant\b", r"\bcarcinoma\b", r"\blymphoma\b", r"\bleukemia\b", r"\bneoplasm\b",
               r"\btumou?r\b"],
    "heart_dis": [r"\bcardiac\b", r"\bheart failure\b", r"\bmyocardial infarction\b", r"\bcoronary\b",
                  r"\batrial fibr", r"\bangina\b"],
    "renal": [r"\brenal failure\b", r"\bkidney failure\b", r"\bCKD\b", r"\bdialysis\b", r"\bnephrop",
              r"\bcreatinine elevated\b"],
    "liver_dis": [r"\bliver failure\b", r"\bhepat(?:itis|ic encephalopathy|orenal)\b", r"\bcirrhosis\b",
                  r"\belevated.*(?:AST|ALT|LFT)\b", r"\bbilirubin\b"],
    "respiratory": [r"\bCOPD\b", r"\basthma\b", r"\bARDS\b", r"\bpneumonia\b", r"\brespiratory failure\b",
                    r"\bmechanical ventilation\b"],
    "sepsis": [r"\bsepsis\b", r"\bseptic shock\b", r"\bbacteremia\b"],
    "stroke": [r"\bstroke\b", r"\bcerebral infarct\b", r"\bTIA\b", r"\bischemic.*brain\b"],
    "mental": [r"\bdepression\b", r"\banxiety disorder\b", r"\bschizophrenia\b", r"\bbipolar\b", r"\bpsychiat"],
    "osteo": [r"\bosteoporosis\b", r"\bosteopenia\b", r"\bone fracture\b", r"\bfragility fracture\b"],
    "anemia": [r"\banemia\b", r"\banaemia\b", r"\biron deficiency\b", r"\bhemoglobin\b.*\blow\b"],
    "thyroid_dis": [r"\bhypothyroid\b", r"\bhyperthyroid\b", r"\bthyroid\b"],
    "vitamin_def": [r"\bvitamin D deficiency\b", r"\bvitamin B12\b", r"\bvitamin deficiency\b"],
    "icu": [r"\bICU\b", r"\bintensive care unit\b", r"\bcritical care\b"],
    "ventilated": [r"\bmechanical ventilation\b", r"\bintubat", r"\bventilat"],
}
CHRONIC = ["diabetic", "hypertension", "cancer", "heart_dis", "renal", "liver_dis", "respiratory", "sepsis",
           "stroke", "mental", "osteo", "anemia", "thyroid_dis"]
SPO2_PATTERNS = [(r"(?:oxygen saturation|SpO2|O2 sat)[^0-9]*(\d{2,3})%", 1), (r"(\d{2,3})%\s*to\s*(\d{2,3})%", 2)]
SEVERITY_WEIGHTS = {"cancer": 0.30, "icu": 0.20, "renal": 0.18, "heart_dis": 0.15, "sepsis": 0.15,
                    "ventilated": 0.15, "stroke": 0.12, "liver_dis": 0.10, "respiratory": 0.08}

# Lower-cased words with which every match of a condition's patterns begins, at a word boundary.
CONDITION_STEMS = {
    "smoker": ["smok", "tobacco"],
    "diabetic": ["diabet", "dm", "insulin", "t2dm", "t1dm"],
    "hypertension": ["hypertension", "high blood pressure", "htn"],
    "cancer": ["cancer", "malignant", "carcinoma", "lymphoma", "leukemia", "neoplasm", "tumo"],
    "heart_dis": ["cardiac", "heart failure", "myocardial infarction", "coronary", "atrial fibr", "angina"],
    "renal": ["renal failure", "kidney failure", "ckd", "dialysis", "nephrop", "creatinine elevated"],
    "liver_dis": ["liver failure", "hepat", "cirrhosis", "elevated", "bilirubin"],
    "respiratory": ["copd", "asthma", "ards", "pneumonia", "respiratory failure", "mechanical ventilation"],
    "sepsis": ["sepsis", "septic shock", "bacteremia"],
    "stroke": ["stroke", "cerebral infarct", "tia", "ischemic"],
    "mental": ["depression", "anxiety disorder", "schizophrenia", "bipolar", "psychiat"],
    "osteo": ["osteoporosis", "osteopenia", "one fracture", "fragility fracture"],
    "anemia": ["anemia", "anaemia", "iron deficiency", "hemoglobin"],
    "thyroid_dis": ["hypothyroid", "hyperthyroid", "thyroid"],
    "vitamin_def": ["vitamin"],
    "icu": ["icu", "intensive care unit", "critical care"],
    "ventilated": ["mechanical ventilation", "intubat", "ventilat"],
}

# The section is lower-cased once and matched case-sensitively against lower-cased
# patterns (the same matches as case-insensitive search, at a fraction of the cost);
# (?d): '.' matches anything but '\n', as in Python.
FLAGS = "(?d)"


def _lower_pattern(p: str) -> str:
    assert not re.search(r"\\[A-Z]", p), p  # no upper-case escapes to break
    return p.lower()


def _any(patterns):
    return FLAGS + "|".join(f"(?:{_lower_pattern(p)})" for p in patterns)


def _words(pattern: str) -> list[str]:
    """Alternatives of a gender pattern, which begin at a word boundary and may end at one."""
    return pattern.removeprefix(r"\b(").removesuffix(")").split("|")


def _begins() -> str:
    """What each condition stem or gender word begins, at every word boundary, without using up the text.

    One branch per first letter; of the entries that share one, none can match where another does.
    """
    tails = {}
    for w in sorted({w for ws in CONDITION_STEMS.values() for w in ws} | {*_words(FEMALE_PATTERN), *_words(MALE_PATTERN)}):
        tails.setdefault(w[0], []).append(w[1:])
    return r"\b(?=(" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in tails.items()) + "))"


def parse_notes(df: DataFrame, text: str = "text") -> DataFrame:
    """MAP9: clinical note -> structured fields (age, gender, BMI, 13 conditions, ICU, SpO2, LR, severity).

    Only the instruction section is searched.  Age: first match of each of four
    patterns in order, accepted when 0 < age < 120 (else the next pattern), default
    45.  Gender by hit counts (ties -> M).  BMI first match in (10, 70), default 26.
    SpO2 first valid of two patterns in 70..100, default 97.
    """
    start = F.instr(F.col(text), "### Instruction:")
    end = F.instr(F.col(text), "### Response:")
    d = df.withColumn("_s", start).withColumn("_e", end).withColumn("_bs", F.col("_s") + 16)
    sec = F.when(F.col("_s") > 0,
                 F.trim(F.when(F.col("_e") > 0,
                               F.expr(f"substr(`{text}`, _bs, greatest(_e - _bs, 0))"))
                        .otherwise(F.expr(f"substr(`{text}`, _bs)")))).otherwise(F.col(text))
    d = d.withColumn("_t", F.lower(sec))
    t = F.col("_t")
    # one scan finds condition stems and gender words; a pattern runs once, on the notes that hold its literal
    found = {f"_age{i}": (pat, 1, AGE_LITERALS[i]) for i, pat in enumerate(AGE_PATTERNS)}
    found |= {f"_ox{i}": (*pg, "%") for i, pg in enumerate(SPO2_PATTERNS)} | {"_bmi": (BMI_PATTERN, 1, "bmi")}
    d = d.withColumns({c: F.when(t.contains(need), F.regexp_extract(t, FLAGS + _lower_pattern(pat), grp)).otherwise("")
                       for c, (pat, grp, need) in found.items()}
                      | {"_begun": F.regexp_extract_all(t, F.lit(_begins()), F.lit(1))})
    of = lambda pat: F.size(F.filter("_begun", lambda w: w.isin([x.removesuffix(r"\b") for x in _words(pat)])))
    d = d.withColumns({"_fem": of(FEMALE_PATTERN), "_mal": of(MALE_PATTERN)})
    age = F.lit(None).cast("double")
    for i in reversed(range(len(AGE_PATTERNS))):
        v = F.col(f"_age{i}")
        vi = F.when(v != "", v.cast("int"))
        age = F.when((vi > 0) & (vi < 120), vi.cast("double")).otherwise(age)
    age = F.coalesce(age, F.lit(45.0))
    bmi_s = F.col("_bmi")
    bmi_v = F.when(bmi_s != "", bmi_s.cast("double"))
    bmi = F.when((bmi_v > 10) & (bmi_v < 70), bmi_v).otherwise(F.lit(26.0))
    spo2 = F.lit(None).cast("double")
    for i in reversed(range(len(SPO2_PATTERNS))):
        v = F.col(f"_ox{i}")
        vd = F.when(v != "", v.cast("double"))
        spo2 = F.when((vd >= 70) & (vd <= 100), vd).otherwise(spo2)
    spo2 = F.coalesce(spo2, F.lit(97.0))
    def cond(k, pats):
        begun = F.arrays_overlap(F.col("_begun"), F.array(*[F.lit(w) for w in CONDITION_STEMS[k]]))
        return F.when(begun, t.rlike(_any(pats))).otherwise(F.lit(False)).cast("int")

    cols = {k: cond(k, v) for k, v in CONDITIONS.items()}
    d = d.select(*[c for c in df.columns if c != text], age.alias("age"),
                 F.when(F.col("_fem") > F.col("_mal"), "F").otherwise("M").alias("gender"), bmi.alias("bmi"),
                 *[e.alias(k) for k, e in cols.items()], spo2.alias("avg_spo2"))
    chronic = sum((F.col(c) for c in CHRONIC), F.lit(0))
    d = d.withColumn("chronic_count", chronic.cast("double"))
    d = (d.withColumn("hospitalized_count", (F.lit(1) + F.col("icu")).cast("double"))
          .withColumn("visit_count", F.least(F.lit(2) + F.col("chronic_count") + F.col("icu") * 2, F.lit(10.0)).cast("double")))
    age_risk = F.greatest(F.col("age") - 18, F.lit(0.0)) / 80 * 0.4
    cond_risk = F.col("chronic_count") * 0.08
    serious = sum((F.col(k) * w for k, w in SEVERITY_WEIGHTS.items()), F.lit(0.0))
    life = F.col("smoker") * 0.10 + (F.greatest(F.col("bmi") - 30, F.lit(0.0)) / 10) * 0.10
    d = (d.withColumn("loss_ratio", F.lit(0.20) + age_risk + cond_risk + serious + life)
          .withColumn("_severity", age_risk + cond_risk + serious))
    return d.withColumns({
        "lab_heart_flag": F.col("heart_dis"), "lab_diabetes_flag": F.col("diabetic"),
        "lab_kidney_flag": F.col("renal"), "lab_liver_flag": F.col("liver_dis"),
        "lab_inflammation_flag": ((F.col("sepsis") == 1) | (F.col("respiratory") == 1)).cast("int"),
        "lab_iron_flag": F.col("anemia"), "lab_thyroid_flag": F.col("thyroid_dis"),
        "lab_bone_flag": ((F.col("osteo") == 1) | (F.col("age") > 60)).cast("int"),
        "lab_vitamin_flag": F.col("vitamin_def"),
    })


def map_notes(parsed: DataFrame, key: str = "note_id", jitter: bool = True) -> DataFrame:
    """MAP10: parsed notes -> feature rows: severity-driven telemetry proxies and jittered LR."""
    n = _Noise(F.col(key), jitter, seed=SEED)
    sev = clamp(F.col("_severity"), 0.0, 1.2)
    h = clamp(F.lit(1.0) - sev / 1.2, 0.0, 1.0)
    u = F.lit(1.0) - h
    return parsed.withColumns({
        "avg_daily_steps": clamp(h * 9000 + 1000 + n.normal("avg_daily_steps", 600), 1000.0, 15000.0),
        "step_volatility": clamp(u * 1400 + 100 + n.normal("step_volatility", 150), 50.0, 3000.0),
        "avg_resting_hr": clamp(u * 22 + 65 + n.normal("avg_resting_hr", 3), 45.0, 110.0),
        "hr_trend": (n.uniform("hr_trend", 0.5) - 0.5) * 6,
        "avg_active_mins": clamp(h * 55 + 5 + n.normal("avg_active_mins", 8), 0.0, 90.0),
        "avg_sleep_hours": clamp(h * 2.0 + 6.0 + n.normal("avg_sleep_hours", 0.5), 3.0, 10.0),
        "avg_spo2": clamp(F.col("avg_spo2") + n.normal("avg_spo2", 0.3), 90.0, 100.0),
        "loss_ratio": clamp(F.col("loss_ratio") * n.lognormal("loss_ratio", 0.25), 0.10, 6.0),
    }).drop("_severity")
