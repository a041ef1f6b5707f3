from bazaar.operators.cohorts import (active_counts, active_pairs, assign_cohort, cohort_activity,
                                     cohort_matrix, retention)
from bazaar.operators.ordering import (global_position, ntile_from_position, ntile_global,
                                      percentile_cont_global, rank_desc, surrogate_key, top_k_ranked)
from bazaar.operators.quality import (ConstraintViolation, assert_keys, duplicate_keys, grain_check,
                                      null_count, orphan_count, orphan_rows, value_distribution,
                                      violating_rows, violation_count)
from bazaar.operators.windows import latest_per_key, period_growth, share_of_total, with_total

__all__ = [
    "active_counts", "active_pairs", "assign_cohort", "cohort_activity", "cohort_matrix",
    "retention", "global_position", "ntile_from_position", "ntile_global",
    "percentile_cont_global", "rank_desc", "surrogate_key", "top_k_ranked", "ConstraintViolation",
    "assert_keys", "duplicate_keys", "grain_check", "null_count", "orphan_count", "orphan_rows",
    "value_distribution", "violating_rows", "violation_count", "latest_per_key",
    "period_growth", "share_of_total", "with_total",
]
