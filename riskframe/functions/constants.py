"""Fixed values.

Everything in this module is a literal that must equal the reference behaviour for
results to match: feature order, monotone signs, weights, lookup tables, alias
lists, thresholds and text templates.  They are stated plainly, in natural order.
"""

# The 31 model features, in order.
FEATURE_COLUMNS = [
    "age", "bmi", "chronic_count", "smoker", "diabetic", "hypertension",
    "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend",
    "avg_active_mins", "avg_sleep_hours", "avg_spo2",
    "visit_count", "hospitalized_count",
    "activity_score", "health_composite",
    "smoker_diabetic", "bmi_age_risk", "clinical_burden",
    "lab_heart_flag", "lab_inflammation_flag", "lab_diabetes_flag",
    "lab_kidney_flag", "lab_liver_flag", "lab_iron_flag",
    "lab_thyroid_flag", "lab_bone_flag", "lab_vitamin_flag",
    "lab_domain_count", "lab_risk_score",
]

# Expected monotone direction per feature (same order as above).
MONOTONE_SIGNS = [
    1, 1, 1, 1, 1, 1,
    -1, 0, 1, 1,
    -1, 0, -1,
    1, 1,
    -1, 1,
    1, 1, 1,
    1, 1, 1, 1, 1, 1, 1, 1, 1,
    1, 1,
]

TARGET = "loss_ratio"
TARGET_LOG = "loss_ratio_log"

# Lab domains and the lab risk-score weights.
LAB_DOMAINS = ["heart", "inflammation", "diabetes", "kidney", "liver", "iron", "thyroid", "bone", "vitamin"]
LAB_FLAGS = [f"lab_{d}_flag" for d in LAB_DOMAINS]
LAB_WEIGHTS = {
    "lab_diabetes_flag": 0.25,
    "lab_heart_flag": 0.20,
    "lab_kidney_flag": 0.18,
    "lab_liver_flag": 0.12,
    "lab_inflammation_flag": 0.10,
    "lab_iron_flag": 0.05,
    "lab_bone_flag": 0.04,
    "lab_thyroid_flag": 0.03,
    "lab_vitamin_flag": 0.03,
}

# Null fills for core features (applied only when the column exists).
CORE_FILLS = {
    "avg_daily_steps": 5000, "step_volatility": 0,
    "avg_resting_hr": 72, "hr_trend": 0,
    "avg_active_mins": 30, "avg_sleep_hours": 7.0,
    "avg_spo2": 97.0,
    "visit_count": 0, "hospitalized_count": 0,
}

# HRS bands (upper bounds, exclusive) and the fairness-report bands.
HRS_BANDS = [(30, "Low"), (60, "Moderate"), (80, "High"), (None, "Critical")]
BAND_NAMES = ["Low", "Moderate", "High", "Critical"]

# Market multipliers for pricing.
INDUSTRY_RISK_MULTIPLIERS = {
    "Agriculture": 1.029, "Automotive": 0.988, "Construction": 0.876, "Consulting": 1.016,
    "Education": 1.011, "Energy": 0.902, "Finance": 0.994, "Food & Beverages": 1.099,
    "Healthcare": 1.034, "Hospitality": 1.01, "IT Services": 0.995, "Logistics": 1.101,
    "Manufacturing": 0.91, "Media": 1.133, "Mining": 0.986, "Pharma": 0.997,
    "Real Estate": 0.991, "Retail": 1.045, "Telecom": 1.135, "Textiles": 1.115,
}
REGION_MULTIPLIERS = {
    "Central": 1.018, "East": 0.934, "North": 1.016, "Northeast": 1.036, "South": 0.965, "West": 1.017,
}
SUM_ASSURED_BAND_MULTIPLIERS = {"1-3L": 0.944, "4-7L": 1.0, "8-15L": 1.202, "15L+": 1.0}
SUM_ASSURED_BANDS = ["1-3L", "4-7L", "8-15L", "15L+"]
DEFAULT_SUM_ASSURED = 5.0

# Premium zone texts.
ZONE_TEXT = {
    "discount": "Low-risk group. Offer preferred rates to retain.",
    "standard": "Average risk. Price at book rate.",
    "loading": "High risk. Apply surcharge or require wellness program.",
}

# Currencies (rate = foreign units per 1 INR).
CURRENCIES = {
    "INR": ("₹", "Indian Rupee", 1.0),
    "USD": ("$", "US Dollar", 0.01198),
    "EUR": ("€", "Euro", 0.01105),
    "GBP": ("£", "British Pound", 0.00943),
    "AED": ("AED ", "UAE Dirham", 0.04400),
    "SGD": ("S$", "Singapore Dollar", 0.01613),
    "AUD": ("A$", "Australian Dollar", 0.01852),
    "JPY": ("¥", "Japanese Yen", 1.8519),
    "CAD": ("C$", "Canadian Dollar", 0.01634),
    "CHF": ("CHF ", "Swiss Franc", 0.01076),
}

# Canonical training-set columns, in order.
CANONICAL_COLS = [
    "employee_id", "company_id", "age", "gender", "bmi",
    "smoker", "diabetic", "hypertension", "job_category",
    "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend",
    "avg_active_mins", "avg_sleep_hours", "avg_spo2",
    "total_claims", "visit_count", "hospitalized_count",
    "premium_share", "loss_ratio", "high_risk", "chronic_count",
    "lab_heart_flag", "lab_inflammation_flag", "lab_diabetes_flag",
    "lab_kidney_flag", "lab_liver_flag", "lab_iron_flag",
    "lab_thyroid_flag", "lab_bone_flag", "lab_vitamin_flag",
    "lab_domain_count", "lab_risk_score",
]

# Accepted header aliases per canonical column (matched after
# lower-casing and stripping non-alphanumerics).
ALIASES = {
    "employee_id": ["employeeid", "empid", "id", "memberid", "personid", "uid"],
    "company_id": ["companyid", "orgid", "employerid", "groupid"],
    "age": ["years", "ageyears", "ageyrs"],
    "gender": ["sex"],
    "bmi": ["bodymassindex"],
    "smoker": ["smokes", "tobacco", "tobaccouse", "issmoker"],
    "diabetic": ["diabetes", "hasdiabetes", "isdiabetic", "dm"],
    "hypertension": ["hypertensive", "highbp", "bp", "hbp"],
    "job_category": ["job", "jobtype", "occupation", "role", "worktype"],
    "avg_daily_steps": ["steps", "dailysteps", "stepsperday", "avgsteps"],
    "step_volatility": ["stepvariance", "stepstddev"],
    "avg_resting_hr": ["restinghr", "rhr", "heartrate", "avgheartrate"],
    "hr_trend": ["heartratetrend", "hrslope"],
    "avg_active_mins": ["activeminutes", "activemins", "exercisemins"],
    "avg_sleep_hours": ["sleephours", "sleep", "avgsleep"],
    "avg_spo2": ["spo2", "oxygensaturation", "avgoxygen"],
    "total_claims": ["claims", "claimamount", "claimstotal", "totalclaim"],
    "visit_count": ["visits", "doctorvisits", "opdvisits"],
    "hospitalized_count": ["hospitalizations", "admits", "ipdcount", "ipdvisits"],
    "premium_share": ["premium", "annualpremium", "premiumpaid"],
    "loss_ratio": ["lossratio", "lr", "claimsratio"],
    "high_risk": ["highrisk", "isrisky", "riskflag"],
    "chronic_count": ["chroniccount", "chronicconditions", "chroniccondcount"],
    "lab_heart_flag": ["heartflag", "labheart", "cardiacflag"],
    "lab_inflammation_flag": ["inflammationflag", "labinflammation", "crpflag"],
    "lab_diabetes_flag": ["diabetesflag", "labdiabetes", "hba1cflag"],
    "lab_kidney_flag": ["kidneyflag", "labkidney", "renalflag"],
    "lab_liver_flag": ["liverflag", "labliver", "hepaticflag"],
    "lab_iron_flag": ["ironflag", "labiron", "anemiaflag"],
    "lab_thyroid_flag": ["thyroidflag", "labthyroid", "tshflag"],
    "lab_bone_flag": ["boneflag", "labbone", "vitdflag"],
    "lab_vitamin_flag": ["vitaminflag", "labvitamin", "vitb12flag"],
    "lab_domain_count": ["labcount", "abnormallabs"],
    "lab_risk_score": ["labrisk", "labscore"],
}

VALID_GENDER = ["M", "F", "O"]
VALID_JOB = ["desk", "field", "manual"]

# Lab marker code (upper-case, alphanumerics only) -> health domain.
MARKER_TO_DOMAIN = {
    "HB": "iron", "HGB": "iron", "HEMOGLOBIN": "iron",
    "PCV": "iron", "HCT": "iron", "HEMATOCRIT": "iron",
    "MCV": "iron", "MCH": "iron", "MCHC": "iron",
    "RBC": "iron", "FERRITIN": "iron", "IRON": "iron", "TIBC": "iron",
    "HBA1C": "diabetes", "HBA1": "diabetes", "GHB": "diabetes",
    "FBS": "diabetes", "FPG": "diabetes", "GLUCOSE": "diabetes",
    "RBS": "diabetes", "PPBS": "diabetes", "OGTT": "diabetes",
    "INSULIN": "diabetes",
    "TC": "heart", "CHOL": "heart", "CHOLESTEROL": "heart",
    "LDL": "heart", "HDL": "heart", "VLDL": "heart",
    "TG": "heart", "TRIG": "heart", "TRIGLYCERIDES": "heart",
    "TROPONIN": "heart", "CKMB": "heart", "BNP": "heart", "NTPROBNP": "heart",
    "APO": "heart", "APOA": "heart", "APOB": "heart",
    "ALT": "liver", "SGPT": "liver",
    "AST": "liver", "SGOT": "liver",
    "ALP": "liver", "GGT": "liver",
    "BILIRUBIN": "liver", "BILT": "liver", "BILD": "liver", "BILI": "liver",
    "ALB": "liver", "ALBUMIN": "liver", "TPROT": "liver",
    "CREATININE": "kidney", "CREA": "kidney", "CR": "kidney",
    "UREA": "kidney", "BUN": "kidney", "EGFR": "kidney",
    "URICACID": "kidney", "UA": "kidney",
    "TSH": "thyroid", "T3": "thyroid", "T4": "thyroid",
    "FT3": "thyroid", "FT4": "thyroid",
    "CALCIUM": "bone", "CA": "bone", "PHOSPHORUS": "bone", "PHOS": "bone",
    "VITD": "bone", "VITAMIND": "bone", "D25OH": "bone",
    "VITB12": "vitamin", "B12": "vitamin", "FOLATE": "vitamin", "FOL": "vitamin",
    "CRP": "inflammation", "HSCRP": "inflammation",
    "ESR": "inflammation", "WBC": "inflammation",
    "ABAS": "inflammation", "ANEU": "inflammation", "ALYM": "inflammation",
    "AMON": "inflammation", "AEOS": "inflammation",
}

# Activity wide-format domain columns -> domain.
ACTIVITY_DOMAIN_COLUMNS = {
    "boneHealth": "bone",
    "diabetes": "diabetes",
    "heartHealth": "heart",
    "inflammation": "inflammation",
    "iron": "iron",
    "kidneyHealth": "kidney",
    "liverHealth": "liver",
    "thyroidHealth": "thyroid",
    "vitaminDeficiency": "vitamin",
}

# Lab status / risk-level spellings that mean out of range.
OOR_STATUS = ["outofrange", "out_of_range", "abnormal", "high", "low", "critical"]
OOR_RISK = ["medium", "med", "moderate", "high", "critical"]

# Telemetry defaults used when scoring uploads.
UPLOAD_TELEMETRY_DEFAULTS = {
    "avg_daily_steps": 6000.0,
    "step_volatility": 500.0,
    "avg_resting_hr": 72.0,
    "hr_trend": 0.0,
    "avg_active_mins": 30.0,
    "avg_sleep_hours": 7.0,
    "avg_spo2": 97.0,
    "visit_count": 0,
    "hospitalized_count": 0,
}

# Population defaults when no reference dataset is available.
POPULATION_DEFAULTS = dict(age=38, gender="M", bmi=25.0, smoker=0, diabetic=0, hypertension=0,
                           job_category="desk")

# Ingestion rules.
EVENT_TYPES = ["general_visit", "hypertension", "diabetes", "respiratory", "injury", "cardiac"]
COMPANY_ID_PATTERN = r"^COMP_\d{3}$"
# Development salt for pseudonymisation; deployments pass their own secret salt.
DEFAULT_HASH_SALT = "riskframe_dev_salt"

# Wearable defaults (used when a value is missing or zero) and clamps.
WEARABLE_RULES = [
    # (output, payload field, default, lo, hi, decimals)
    ("avg_daily_steps", "daily_steps", 5000, 500, 30000, None),
    ("resting_hr", "heart_rate_rest", 72, 45, 110, None),
    ("active_minutes", "active_mins", 30, 0, 240, None),
    ("sleep_hours", "sleep_hrs", 7.0, 3.0, 12.0, 1),
    ("spo2", "oxygen_saturation", 97.0, 85.0, 100.0, 1),
]
# Payload field aliases.
WEARABLE_ALIASES = {
    "daily_steps": "steps",
    "heart_rate_rest": "restingHR",
    "active_mins": "activeMinutes",
    "sleep_hrs": "sleepHours",
    "oxygen_saturation": "SpO2",
}
