"""Label vocabularies and the Column expressions that apply them.

The label texts, score cut-offs, digit pairs and regex patterns below are
fixed values: they must equal the segment definitions users already rely on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: RFM score labels (score cut-offs, highest first) --------
# score >= 4.5 Champion; > 4 Potential loyalist; > 3 Need attention;
# > 1.6 At risk; otherwise Lost.
SCORE_LABELS = [
    (">=", 4.5, "Champion"),
    (">", 4.0, "Potential loyalist"),
    (">", 3.0, "Need attention"),
    (">", 1.6, "At risk"),
]
SCORE_DEFAULT = "Lost"

# --- fixed values: segment by the first two digits of the r-f-m cluster code
SEGMENT_BY_RF = {
    "30": "Promising",
    "23": "Loyal", "24": "Loyal", "33": "Loyal", "34": "Loyal", "43": "Loyal",
    "32": "Potential loyalist", "31": "Potential loyalist",
    "42": "Potential loyalist", "41": "Potential loyalist",
    "21": "Need attention", "22": "Need attention", "12": "Need attention", "11": "Need attention",
    "40": "New",
    "20": "About to sleep",
    "14": "Cant loose them", "04": "Cant loose them",
    "10": "Lost", "00": "Lost", "01": "Lost",
    "02": "At risk", "03": "At risk", "13": "At risk",
    "44": "Champion",
}

# --- fixed values: quantile-code labels, first matching pattern wins -------
QUANTILE_CODE_PATTERNS = [
    (r"44.", "Champions"),
    (r"[2,3,4][3,4].", "Loyal"),
    (r"[3,4][1,2].", "Potential Loyal"),
    (r"[1,2][1,2].", "Need Attention"),
    (r"41.", "New Customers"),
    (r"21.", "Hibernating"),
    (r"[1,0]4.", "Cant Loose"),
    (r"[1,0][1,0].", "Lost"),
    (r"[1,0][2,3].", "At Risk"),
    (r"40.", "New Customers"),
]


def score_label(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    expr = None
    for op, cut, label in SCORE_LABELS:
        cond = (s >= F.lit(cut)) if op == ">=" else (s > F.lit(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(SCORE_DEFAULT))


def segment_from_code(code: Column | str, mapping: dict | None = None) -> Column:
    """Segment name from the first two characters of an r-f-m code (the
    third digit is not used); codes outside the map stay as they are."""
    c = F.col(code) if isinstance(code, str) else code
    mapping = mapping or SEGMENT_BY_RF
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.substring(c, 1, 2)), c)


def regex_label(code: Column | str, ordered_patterns=None) -> Column:
    """First pattern matching at the start of the code gives the label; no
    match keeps the code itself."""
    c = F.col(code) if isinstance(code, str) else code
    ordered_patterns = ordered_patterns or QUANTILE_CODE_PATTERNS
    expr = None
    for pat, label in ordered_patterns:
        cond = c.rlike("^(?:" + pat + ")")
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(c)
