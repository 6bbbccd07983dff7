from cohortspark.functions.columns import (  # noqa: F401
    binary_target, clip, ordinal_encode, period_end, period_start, safe_ratio, bare_ratio,
    threshold_flag, round_half_even, safe_log, safe_log10, safe_log2, safe_log1p, masked_update,
    all_present,
)
