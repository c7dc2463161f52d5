"""Registry of named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every entry reads the given tables (through the bank views) so its work grows
with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerguard.plans import queries as Q
from ledgerguard.plans.context import RiskContext

QUERIES: dict[str, Callable[[RiskContext], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


for _name, _fn in [
    ("q1", Q.q1_fraud_accounts_this_week), ("q2", Q.q2_lcr_trend), ("q3", Q.q3_watch_list_by_sector),
    ("q4", Q.q4_high_risk_customers_fraud), ("q5", Q.q5_open_flags_summary), ("q6", Q.q6_structuring_detail),
    ("q7", Q.q7_rwa_by_sector_rating), ("q8", Q.q8_lcr_breach_detail),
]:
    QUERIES[_name] = _fn


from ledgerguard.plans import detect_queries as DQ  # noqa: E402

QUERIES.update(DQ.ENTRIES)

from ledgerguard.plans import semantic_queries as SQ  # noqa: E402

QUERIES.update(SQ.ENTRIES)

from ledgerguard.plans import dashboard as DB  # noqa: E402

QUERIES.update(DB.ENTRIES)

from ledgerguard.plans import ops_queries as OQ  # noqa: E402

QUERIES.update(OQ.ENTRIES)

from ledgerguard.plans import search_queries as RQ  # noqa: E402

QUERIES.update(RQ.ENTRIES)

from ledgerguard.plans import misc_queries as MQ  # noqa: E402

QUERIES.update(MQ.ENTRIES)


_CONTEXTS: dict[tuple, RiskContext] = {}


def context_for(spark: SparkSession, sf_dir: str) -> RiskContext:
    """One context (bank views + derived plans) per session and data folder.

    DataFrames are immutable plans, so queries of the same session share them instead of
    re-building and re-analysing the same views for every query."""
    key = (id(spark), sf_dir)
    ctx = _CONTEXTS.get(key)
    if ctx is None or ctx.spark is not spark:
        ctx = _CONTEXTS[key] = RiskContext(spark, sf_dir)
    return ctx


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(context_for(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}
