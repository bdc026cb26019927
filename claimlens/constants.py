"""Fixed values that must equal the reference's for identical results.

FIXED VALUES - vocabularies, orders, thresholds and rule parameters, stated
as text in their natural order.
"""

# --- fixed values: closed vocabularies -------------------------------------
# CMG (case-mix main group) vocabulary, in the reference's listed order.
CMG = ["-", "G", "H", "U", "J", "I", "K", "B", "M", "L", "E", "N", "V",
       "W", "O", "P", "D", "C", "A", "F", "T", "S", "Z", "Q", "QP",
       "SA", "ST", "SF", "YY", "DD", "II", "IJ", "RR", "CD", "X"]
# case type: "-" then the digits 0..9 (built from a rule)
CASE_TYPE = ["-"] + [str(i) for i in range(0, 10)]
# specific case: "-" then 1..99 (built from a rule)
SPECIFIC_CASE = ["-"] + [str(i) for i in range(1, 100)]
# severity, ordered (ordinal code = position)
SEVERITY = ["-", "0", "I", "II", "III"]
# ICD-10 chapter labels in the reference's (lexicographic) category order
ICD10_CHAPTERS = ["I", "II", "III", "IV", "IX", "V", "VI", "VII", "VIII",
                  "X", "XI", "XII", "XIII", "XIV", "XIX", "XV", "XVI",
                  "XVII", "XVIII", "XX", "XXI", "XXII"]
# sex, ordered
SEX = ["L", "P"]
# kdsa severities kept as they are; anything else becomes "III"
KDSA_SEVERITY_KEPT = ["-", "I", "II", "III"]
KDSA_SEVERITY_OTHER = "III"

# --- fixed values: ICD-10 chapter rules (applied in this order, later wins) -
# (chapter, letters, min number inclusive or None, max number inclusive or None)
ICD10_RULES = [
    ("I", ["A", "B"], None, None),
    ("II", ["C"], None, None),
    ("II", ["D"], None, 48),
    ("III", ["D"], 50, None),
    ("IV", ["E"], None, None),
    ("V", ["F"], None, None),
    ("VI", ["G"], None, None),
    ("VII", ["H"], None, 59),
    ("VIII", ["H"], 60, None),
    ("IX", ["I"], None, None),
    ("X", ["J"], None, None),
    ("XI", ["K"], None, None),
    ("XII", ["L"], None, None),
    ("XIII", ["M"], None, None),
    ("XIV", ["N"], None, None),
    ("XV", ["O"], None, None),
    ("XVI", ["P"], None, None),
    ("XVII", ["Q"], None, None),
    ("XVIII", ["R"], None, None),
    ("XIX", ["S", "T"], None, None),
    ("XX", ["V", "X", "Y"], None, None),
    ("XXI", ["Z"], None, None),
]
ICD10_DEFAULT = "XXII"

# --- fixed values: diagnosis code fixes ------------------------------------
DIAG_WHOLE_VALUE_FIXES = {"H8.14": "H81.4", "ZO3.9": "Z03.9"}
DIAG_INVALID = "Z09.8"
DIAG_LEN = 3

# --- fixed values: text columns and missing tokens -------------------------
TEXT_COLUMNS = ["typefaskes", "jenkel", "politujuan", "diagfktp", "cbg",
                "kdsa", "kdsp", "kdsr", "kdsi", "kdsd"]
MISSING_TEXT = "NAN"
# scoring-time missing tokens, mapped to "NAN" in these six columns
SCORING_TOKEN_COLUMNS = ["kdsa", "kdsp", "kdsr", "kdsi", "kdsd", "diagfktp"]
SCORING_MISSING_TOKENS = ["-", "nan", "None", "NAN", ""]

# --- fixed values: imputation ----------------------------------------------
MODE_COLUMNS = ["jenispulang", "jenkel", "pisat", "diagfktp",
                "kdsa", "kdsp", "kdsr", "kdsi", "kdsd"]
MEDIAN_COLUMNS = ["biaya"]

# --- fixed values: code split layout (column, parts kept) ------------------
# parts are named CMG, tipekasus, spesifikkasus, severity
CODE_PARTS = [
    ("cbg", ["CMG", "tipekasus", "spesifikkasus", "severity"]),
    ("kdsa", ["CMG", "tipekasus", "spesifikkasus", "severity"]),
    ("kdsp", ["spesifikkasus", "severity"]),
    ("kdsr", ["spesifikkasus", "severity"]),
    ("kdsi", ["spesifikkasus"]),
    ("kdsd", ["spesifikkasus", "severity"]),
]

# --- fixed values: encoder column groups, in output order ------------------
KNOWN_CAT_COLUMNS = ["cbg_CMG", "cbg_tipekasus", "cbg_spesifikkasus",
                     "kdsa_CMG", "kdsa_tipekasus", "kdsa_spesifikkasus",
                     "kdsp_spesifikkasus", "kdsr_spesifikkasus",
                     "kdsi_spesifikkasus", "kdsd_spesifikkasus",
                     "diagfktp_icd10", "diagfkrtl_icd10"]
KNOWN_CAT_VOCAB = {
    "cbg_CMG": CMG, "cbg_tipekasus": CASE_TYPE, "cbg_spesifikkasus": SPECIFIC_CASE,
    "kdsa_CMG": CMG, "kdsa_tipekasus": CASE_TYPE, "kdsa_spesifikkasus": SPECIFIC_CASE,
    "kdsp_spesifikkasus": SPECIFIC_CASE, "kdsr_spesifikkasus": SPECIFIC_CASE,
    "kdsi_spesifikkasus": SPECIFIC_CASE, "kdsd_spesifikkasus": SPECIFIC_CASE,
    "diagfktp_icd10": ICD10_CHAPTERS, "diagfkrtl_icd10": ICD10_CHAPTERS,
}
OPEN_CAT_COLUMNS = ["typefaskes"]
ORDINAL_COLUMNS = ["jenkel", "cbg_severity", "kdsa_severity",
                   "kdsp_severity", "kdsr_severity", "kdsd_severity"]
ORDINAL_VOCAB = {"jenkel": SEX, "cbg_severity": SEVERITY, "kdsa_severity": SEVERITY,
                 "kdsp_severity": SEVERITY, "kdsr_severity": SEVERITY, "kdsd_severity": SEVERITY}
NUMERIC_COLUMNS = ["jenispulang", "pisat", "biaya", "usia", "jenispel",
                   "kelasrawat", "lama_rawat", "diagfkrtl_sekunder_counts", "proc_count"]

# --- fixed values: scoring and training parameters -------------------------
DEFAULT_THRESHOLD = 0.7868109
CONFIDENCE_EPS = 1e-6
CURVE_EPS = 1e-10
SAMPLE_FRACTION = 0.02
SEED = 42
TEST_SIZE = 0.2
VAL_SIZE = 0.25
OVERSAMPLE_RATIO = 0.19676221847208702
OVERSAMPLE_K = 858
UNDERSAMPLE_RATIO = 0.8849275028627146
GBT_ROUNDS = 1000
GBT_LEARNING_RATE = 0.05377367769556463
GBT_MAX_DEPTH = 64
GBT_COLSAMPLE = 0.5
GBT_EARLY_STOP = 100
GBT_ALPHA = 1.8796306666826916
GBT_LAMBDA = 0.01
GBT_MIN_LEAF_WEIGHT = 1.0
EVAL_SUBSAMPLE = 10000
CURVE_POINTS = 50
# risk reasons: cost, stay, secondary diagnoses, procedures (strictly greater)
REASON_COST = 10_000_000
REASON_STAY_DAYS = 10
REASON_SECONDARY = 4
REASON_PROCEDURES = 5

# --- fixed values: headline figures shown when a run record lacks them ------
HEADLINE_DEFAULTS = {"precision": 0.900, "recall": 0.400, "f1_score": 0.550,
                     "classification_threshold": 0.7868109, "sample_fraction": 0.05,
                     "num_features": 342, "training_date": "N/A"}
