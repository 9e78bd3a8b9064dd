from cohort_engine.sources.bindings import (  # noqa: F401
    claims_scores,
    claims_wide,
    cohort,
    doc_quality,
    score_table,
    vectors,
)
from cohort_engine.sources.tables import (  # noqa: F401
    nan_to_null,
    read_optional,
    read_table,
    require_sources,
    table,
    write_table,
)
