"""Query plans: the registry of named queries and their SQL oracles."""

from cohort_engine.plans import catalog  # noqa: F401  (registers queries)
from cohort_engine.plans.registry import REGISTRY, oracle_text, spark_query


def queries():
    return {name: spark_query(name) for name in REGISTRY}


def oracle_sql():
    out = {}
    for name in REGISTRY:
        s = oracle_text(name)
        if s is not None:
            out[name] = s
    return out
