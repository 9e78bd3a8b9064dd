"""cohort_engine: Spark-native cohort risk analytics.

Every operator takes a DataFrame plus column names and returns a lazy
DataFrame (or a small fitted-parameter object).  Nothing row-sized is
collected to the driver; only fitted parameters (a handful of numbers per
column) are.
"""

from cohort_engine.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
