from bazaar.functions.dates import (days_between, month_index, month_start, months_apart,
                                   whole_months_between)
from bazaar.functions.numeric import (MONEY, MONEY_TOTAL, as_money, exact_mean, money_sum,
                                      round_ratio, safe_ratio)
from bazaar.functions.rfm import SEGMENT_NAMES, rfm_code, rfm_segment

__all__ = [
    "days_between", "month_index", "month_start", "months_apart", "whole_months_between",
    "MONEY", "MONEY_TOTAL", "as_money", "exact_mean", "money_sum", "round_ratio", "safe_ratio",
    "SEGMENT_NAMES", "rfm_code", "rfm_segment",
]
