from cohort_engine.functions.scalar import (  # noqa: F401
    bucketize,
    clip,
    code_label,
    confidence_band,
    guarded_ratio,
    nonneg_gap,
    normalize_name,
    pct_text,
    risk_band,
    safe_number,
    sigmoid,
)
