"""RFM score string and segment rules as one ordered CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names and rules on the recency (r), frequency (f) and
# monetary (m) scores, 1..5 with 5 = best, in this order; the first match wins,
# rows that match none are "Others".
SEGMENT_RULES = (
    ("Champions", lambda r, f, m: (r >= 4) & (f >= 4) & (m >= 4)),
    ("Loyal Customers", lambda r, f, m: (r >= 4) & (f >= 3)),
    ("New Customers", lambda r, f, m: (r == 5) & (f <= 2)),
    ("Potential Loyalist", lambda r, f, m: (r >= 3) & (f >= 2) & (m >= 3)),
    ("Need Attention", lambda r, f, m: (r == 3) & (f == 1)),
    ("At Risk", lambda r, f, m: (r <= 2) & (f >= 3)),
    ("Hibernating", lambda r, f, m: (r == 1) & (f <= 2)),
)
OTHERS = "Others"
SEGMENT_NAMES = tuple(name for name, _ in SEGMENT_RULES) + (OTHERS,)


def rfm_segment(r: str = "r_score", f: str = "f_score", m: str = "m_score") -> Column:
    """Segment of the scores in columns ``r``, ``f``, ``m``."""
    scores = [F.col(c) for c in (r, f, m)]
    out = F.lit(OTHERS)
    for name, rule in reversed(SEGMENT_RULES):
        out = F.when(rule(*scores), F.lit(name)).otherwise(out)
    return out


def rfm_code(r: Column, f: Column, m: Column) -> Column:
    """'rfm' digits, NULL if any score is NULL (|| semantics)."""
    return F.concat(r.cast("string"), f.cast("string"), m.cast("string"))
