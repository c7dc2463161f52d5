"""Registered entries for the metric layer and named filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerguard.plans import semantic as S

c = F.col
TABLES = ["risk_flags", "transactions", "accounts", "customers", "credit_exposures", "liquidity_positions"]

ENTRIES = {}
for _t in TABLES:
    ENTRIES[f"metrics_{_t}"] = (lambda t: lambda ctx: S.table_metrics(ctx, t))(_t)
    ENTRIES[f"filters_{_t}"] = (lambda t: lambda ctx: S.table_filter_counts(ctx, t))(_t)
for _t in ["risk_flags", "transactions", "accounts", "credit_exposures", "liquidity_positions"]:
    ENTRIES[f"facts_{_t}"] = (lambda t: lambda ctx: S.table_facts(ctx, t))(_t)


def metric_query_multi(ctx):
    """Transactions metrics by customer segment and account type (two many-to-one hops)."""
    return S.metric_query(ctx, ["total_flagged_transactions", "total_flagged_amount", "flagged_transaction_rate"],
                          ["customers.segment", "accounts.account_type"])


def metric_query_two_facts(ctx):
    """Metrics of two fact tables by a shared dimension: aggregated apart, then joined (no fan-out)."""
    return S.metric_query(ctx, ["open_flag_count", "critical_flag_count", "watch_list_count", "total_rwa"],
                          ["customers.segment"])


def metric_query_time(ctx):
    """Time dimension with a day grain plus a named filter."""
    return S.metric_query(ctx, ["total_flagged_transactions", "total_flagged_amount"], ["txn_date:day", "channel"],
                          filters=["this_week"])


def metric_query_ranked(ctx):
    """Ordered, limited metric request."""
    return S.metric_query(ctx, ["total_rwa", "watch_list_count"], ["sector", "internal_rating"],
                          filters=["watch_list_exposures"],
                          order=[c("total_rwa").desc(), c("sector"), c("internal_rating")], limit=10)


def metric_query_filter_joined(ctx):
    """A filter of a joined table (two hops) beside one of the base table."""
    return S.metric_query(ctx, ["total_flagged_transactions", "total_flagged_amount"], ["accounts.account_type"],
                          filters=["high_risk_customers", "this_week"])


def metric_query_facts(ctx):
    """Facts by their default aggregation and any dimension."""
    return S.metric_query(ctx, ["transactions.amount", "transactions.flag_score"], ["customers.segment"])


def metric_query_two_facts_filtered(ctx):
    """A filter that both fact tables reach applies to both."""
    return S.metric_query(ctx, ["open_flag_count", "total_rwa"], ["customers.segment"], filters=["high_risk_customers"])


ENTRIES.update({"metric_query_filter_joined": metric_query_filter_joined, "metric_query_facts": metric_query_facts,
                "metric_query_two_facts_filtered": metric_query_two_facts_filtered})
ENTRIES.update({"metric_query_multi": metric_query_multi, "metric_query_two_facts": metric_query_two_facts,
                "metric_query_time": metric_query_time, "metric_query_ranked": metric_query_ranked})
