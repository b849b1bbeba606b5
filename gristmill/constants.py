"""Fixed values that decide results. Changing one changes what the library computes."""

# Text that stands for "no value" once trimmed and lower-cased.
BLANK_MARKERS = [
    "", "n/a", "n.a.", "#n/a", "na", "null", "none", "nil", "-", "--", "?", "\\n",
    "nan", "unknown", "missing",
]

# Cell texts that become null while a CSV file is read
# (the documented default null tokens of the pandas CSV reader).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Known two-way categories, tried in this order.
CATEGORY_GROUPS = [
    {"m": "Male", "male": "Male", "f": "Female", "female": "Female"},
    {"y": "Yes", "yes": "Yes", "n": "No", "no": "No"},
    {"true": "True", "t": "True", "false": "False", "f": "False"},
]

# What a date looks like, and a number written as a code.
DATE_LIKE = (
    r"(?i)\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"
    r"|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
)
LEADING_ZERO = r"^-?0\d"

# Names of identifiers, by the word "id" or by a camel-case ending.
ID_WORD = r"(?i)(?:^|[\s_\-.])id(?:[\s_\-.]|$)"
ID_CAMEL_END = r"[a-z](?:Id|ID)$"

# Shares, limits and lengths of lists that decide results, and the text that fills gaps.
DATE_LIKE_SHARE = 0.5
DATE_PARSED_SHARE = 0.9

TEXT_FILL = "Unknown"

MIN_KEY_OVERLAP = 0.3

MALFORMED_LISTED = 20
TOP_VALUES = 5
DUPLICATE_ROW_EXAMPLES = 3
DUPLICATE_VALUE_EXAMPLES = 3
NEAR_UNIQUE_SHARE = 0.9

CORRELATIONS_LISTED = 15
STRONG_CORRELATION = 0.7
MODERATE_CORRELATION = 0.5

GROUP_COLUMNS_LISTED = 5
GROUPS_LISTED = 8
GROUP_MIN_DISTINCT = 2
GROUP_MAX_DISTINCT = 50
GROUP_MAX_DISTINCT_SHARE = 0.5

OUTLIER_MIN_ROWS = 5
OUTLIER_FENCE = 1.5
OUTLIER_EXAMPLES = 5

# Rule names, reasons and their wording in reports.
RULE_NAMES = [
    "blank_like_converted_to_null",
    "whitespace_trimmed",
    "dates_standardized",
    "categories_standardized",
    "casing_standardized",
    "converted_to_numeric",
    "missing_values_filled",
]
ALL_EMPTY = "All fields empty except the ID"
MISSING_REASON = "Missing values in: "
DUPLICATE_REASON = "Exact duplicate - matches %d other row(s) (group %d)"
CONFLICT_REASON = "Same {id} as another row, but differs in: "

# Shortest span in days for each period, longest first.
PERIODS = [(730, "year"), (90, "month"), (14, "week"), (0, "day")]

STEM_LENGTH = 31
