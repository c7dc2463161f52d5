"""Metric layer (O-M0..O-M22) and named filters (O-F1..O-F23).

The model is data: per table a dimension map, time dimensions, facts with a
default aggregation, named filters and metrics (each a Column builder), plus
many-to-one relationships.  :func:`metric_query` turns a request
(metrics, dimensions, filters, order, limit) into one DataFrame plan:

* the base table is the table of the metrics; dimensions of other tables are
  reached by left-outer joins along many-to-one relationships (never fan out);
* metrics from several fact tables are aggregated separately, each grouped by
  the shared dimensions, and the partial results joined on those dimensions;
* filters are applied before aggregation so Catalyst pushes them to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.session import ts_lit

c = F.col
Ctx = object


def _cnt(pred: Column) -> Column:
    return F.sum(F.when(pred, 1).otherwise(0)).cast("bigint")


@dataclass
class TableModel:
    name: str
    source: Callable  # ctx -> DataFrame
    key: str
    dimensions: dict[str, str] = field(default_factory=dict)        # name -> column
    time_dimensions: dict[str, str] = field(default_factory=dict)   # name -> column
    facts: dict[str, tuple[str, str]] = field(default_factory=dict)  # name -> (column, default agg)
    filters: dict[str, Callable] = field(default_factory=dict)      # name -> ctx -> Column
    metrics: dict[str, Callable] = field(default_factory=dict)      # name -> ctx -> agg Column


def _days_ago(ctx, n):
    return ts_lit(ctx.as_of) - F.expr(f"INTERVAL {n} DAYS")


MODEL: dict[str, TableModel] = {
    "risk_flags": TableModel(
        "risk_flags", lambda ctx: ctx.risk_flags, "flag_id",
        dimensions={"flag_domain": "flag_domain", "flag_type": "flag_type", "severity": "severity",
                    "flag_status": "flag_status", "threshold_rationale": "threshold_rationale",
                    "action_taken": "action_taken"},
        time_dimensions={"flagged_at": "created_at"},
        facts={"flag_score": ("flag_score", "avg"), "threshold_value": ("threshold_value", "avg"),
               "threshold_limit": ("threshold_limit", "avg")},
        filters={"open_flags": lambda ctx: c("flag_status") == "OPEN",
                 "fraud_flags": lambda ctx: c("flag_domain") == "FRAUD",
                 "credit_flags": lambda ctx: c("flag_domain") == "CREDIT",
                 "liquidity_flags": lambda ctx: c("flag_domain") == "LIQUIDITY",
                 "critical_and_high_flags": lambda ctx: c("severity").isin("HIGH", "CRITICAL")},
        metrics={"open_flag_count": lambda ctx: _cnt(c("flag_status") == "OPEN"),
                 "critical_flag_count": lambda ctx: _cnt(c("severity") == "CRITICAL"),
                 "avg_fraud_score": lambda ctx: F.avg(F.when(c("flag_domain") == "FRAUD", c("flag_score")))
                 .cast("decimal(18,6)")}),
    "transactions": TableModel(
        "transactions", lambda ctx: ctx.transactions, "txn_id",
        dimensions={"fraud_pattern": "fraud_pattern", "channel": "channel", "txn_type": "txn_type",
                    "country_code": "country_code", "is_high_risk_country": "high_risk_country",
                    "review_status": "review_status", "txn_category": "txn_category", "is_flagged": "is_flagged"},
        time_dimensions={"txn_date": "txn_ts"},
        facts={"amount": ("amount", "sum"), "flag_score": ("flag_score", "avg")},
        filters={"flagged_transactions": lambda ctx: c("is_flagged"),
                 "this_week": lambda ctx: c("txn_ts") >= _days_ago(ctx, 7),
                 "high_risk_country_transactions": lambda ctx: c("high_risk_country"),
                 "structuring_pattern": lambda ctx: c("fraud_pattern") == "STRUCTURING"},
        metrics={"total_flagged_transactions": lambda ctx: _cnt(c("is_flagged")),
                 "total_flagged_amount": lambda ctx: F.sum(F.when(c("is_flagged"), c("amount")).otherwise(0))
                 .cast("decimal(18,2)"),
                 "flagged_transaction_rate": lambda ctx: F.round(
                     F.sum(F.when(c("is_flagged"), 1).otherwise(0)).cast("decimal(20,1)") * 100
                     / F.nullif(F.count("txn_id"), F.lit(0)), 2).cast("decimal(18,2)")}),
    "accounts": TableModel(
        "accounts", lambda ctx: ctx.accounts, "account_id",
        dimensions={"account_type": "account_type", "account_status": "status", "is_npa": "npa_flag",
                    "npa_classification": "npa_classification", "currency": "currency",
                    "branch_code": "branch_code"},
        facts={"balance": ("balance", "sum"), "credit_limit": ("credit_limit", "sum"),
               "utilisation_pct": ("utilisation_pct", "avg")},
        filters={"npa_accounts": lambda ctx: c("npa_flag"),
                 "active_accounts": lambda ctx: c("status") == "ACTIVE",
                 "frozen_accounts": lambda ctx: c("status") == "FROZEN",
                 "over_utilised_accounts": lambda ctx: c("utilisation_pct") > 90},
        metrics={"npa_account_count": lambda ctx: _cnt(c("npa_flag")),
                 "total_balance": lambda ctx: F.sum("balance").cast("decimal(18,2)"),
                 "avg_utilisation": lambda ctx: F.avg(F.when(c("credit_limit").isNotNull(), c("utilisation_pct")))
                 .cast("decimal(18,6)")}),
    "customers": TableModel(
        "customers", lambda ctx: ctx.customers, "customer_id",
        dimensions={"segment": "segment", "risk_rating": "risk_rating", "kyc_status": "kyc_status",
                    "is_pep": "pep_flag", "is_sanctioned": "sanction_flag", "nationality": "nationality"},
        filters={"high_risk_customers": lambda ctx: c("risk_rating") == "HIGH",
                 "pep_customers": lambda ctx: c("pep_flag"),
                 "sanctioned_customers": lambda ctx: c("sanction_flag"),
                 "expired_kyc": lambda ctx: c("kyc_status") == "EXPIRED"},
        metrics={"high_risk_customer_count": lambda ctx: _cnt(c("risk_rating") == "HIGH"),
                 "pep_customer_count": lambda ctx: _cnt(c("pep_flag")),
                 "sanctioned_customer_count": lambda ctx: _cnt(c("sanction_flag"))}),
    "credit_exposures": TableModel(
        "credit_exposures", lambda ctx: ctx.credit_exposures, "exposure_id",
        dimensions={"facility_type": "facility_type", "internal_rating": "internal_rating", "sector": "sector",
                    "is_watch_list": "watch_list_flag", "collateral_type": "collateral_type"},
        facts={"outstanding": ("outstanding", "sum"), "pd_score": ("pd_score", "avg"), "lgd": ("lgd", "avg"),
               "ead": ("ead", "sum"), "expected_loss": ("expected_loss", "sum"), "rwa": ("rwa", "sum"),
               "utilisation_pct": ("utilisation_pct", "avg")},
        filters={"watch_list_exposures": lambda ctx: c("watch_list_flag"),
                 "real_estate_sector": lambda ctx: c("sector") == "REAL_ESTATE",
                 "unsecured_exposures": lambda ctx: c("collateral_type") == "UNSECURED"},
        metrics={"watch_list_count": lambda ctx: _cnt(c("watch_list_flag")),
                 "total_rwa": lambda ctx: F.sum("rwa").cast("decimal(18,2)"),
                 "total_expected_loss": lambda ctx: F.sum("expected_loss").cast("decimal(18,2)"),
                 "avg_pd": lambda ctx: F.avg("pd_score").cast("decimal(18,8)"),
                 "real_estate_outstanding": lambda ctx: F.sum(
                     F.when(c("sector") == "REAL_ESTATE", c("outstanding")).otherwise(0)).cast("decimal(18,2)")}),
    "liquidity_positions": TableModel(
        "liquidity_positions", lambda ctx: ctx.liquidity_positions, "position_id",
        dimensions={"tenor_bucket": "tenor_bucket", "is_lcr_breach": "lcr_breach",
                    "is_nsfr_breach": "nsfr_breach", "stress_scenario": "stress_scenario"},
        time_dimensions={"position_date": "position_date"},
        facts={"lcr_ratio": ("lcr_ratio", "avg"), "nsfr_ratio": ("nsfr_ratio", "avg"), "inflow": ("inflow", "sum"),
               "outflow": ("outflow", "sum"), "net_position": ("net_position", "sum"),
               "hqla_total": ("lcr_numerator", "sum")},
        filters={"lcr_breach_days": lambda ctx: c("lcr_breach"),
                 "short_term_buckets": lambda ctx: c("tenor_bucket").isin("0_7D", "8_30D"),
                 "base_scenario": lambda ctx: c("stress_scenario") == "BASE"},
        metrics={"lcr_breach_day_count": lambda ctx: _cnt(c("lcr_breach")),
                 "avg_lcr_ratio": lambda ctx: F.avg("lcr_ratio").cast("decimal(18,8)"),
                 "avg_lcr_last_30_days": lambda ctx: F.avg(
                     F.when(c("position_date") >= F.date_sub(F.to_date(ts_lit(ctx.as_of)), 30), c("lcr_ratio")))
                 .cast("decimal(18,8)")}),
}

# (left table, right table, left column, right column) -- all many-to-one, left outer
RELATIONSHIPS = [
    ("transactions", "accounts", "account_id", "account_id"),
    ("accounts", "customers", "customer_id", "customer_id"),
    ("credit_exposures", "customers", "customer_id", "customer_id"),
    ("risk_flags", "accounts", "account_id", "account_id"),
    ("risk_flags", "customers", "customer_id", "customer_id"),
]


def metric_table(metric: str) -> str:
    """The table of a named metric, or of a fact asked for as ``table.fact``."""
    table, _, name = metric.partition(".")
    if name and name in MODEL[table].facts:
        return table
    for t in MODEL.values():
        if metric in t.metrics:
            return t.name
    raise KeyError(f"unknown metric {metric}")


def filter_table(name: str) -> str:
    for t in MODEL.values():
        if name in t.filters:
            return t.name
    raise KeyError(f"unknown filter {name}")


def named_filter(ctx, name: str) -> Column:
    """O-F*: the predicate of a named filter."""
    return MODEL[filter_table(name)].filters[name](ctx)


def metric(ctx, name: str) -> Column:
    """O-M1..O-M20: the aggregate Column of a metric; O-M21: ``table.fact`` by its default aggregation."""
    if "." in name:
        return _fact_column(*MODEL[metric_table(name)].facts[name.split(".", 1)[1]], name.split(".", 1)[1])
    return MODEL[metric_table(name)].metrics[name](ctx).alias(name)


def fact(name: str, table: str, agg: str | None = None) -> Column:
    """O-M21: a fact with its default (or given) aggregation."""
    col, default = MODEL[table].facts[name]
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg or default]
    return fn(c(col)).alias(f"{agg or default}_{name}")


def _fact_column(col: str, agg: str, name: str) -> Column:
    if agg == "sum":
        return F.sum(c(col)).cast("decimal(18,2)").alias(f"sum_{name}")
    return F.avg(c(col).cast("decimal(18,8)")).cast("decimal(18,8)").alias(f"avg_{name}")


def _path(base: str, target: str) -> list[tuple[str, str, str, str]] | None:
    """Shortest chain of many-to-one relationships from base to target."""
    frontier = [(base, [])]
    seen = {base}
    while frontier:
        nxt = []
        for t, path in frontier:
            if t == target:
                return path
            for rel in RELATIONSHIPS:
                if rel[0] == t and rel[1] not in seen:
                    seen.add(rel[1])
                    nxt.append((rel[1], path + [rel]))
        frontier = nxt
    return None


def _dimension_column(base: str, dim: str):
    """Resolve 'table.dim' / 'dim' / 'time_dim:grain' to (table, column, output name, grain)."""
    grain = None
    if ":" in dim:
        dim, grain = dim.split(":", 1)
    table, name = dim.split(".", 1) if "." in dim else (None, dim)
    candidates = [table] if table else [base] + [t for t in MODEL if t != base]
    for t in candidates:
        m = MODEL[t]
        if name in m.dimensions:
            return t, m.dimensions[name], name, None
        if name in m.time_dimensions:
            return t, m.time_dimensions[name], name, grain or "day"
    raise KeyError(f"unknown dimension {dim}")


def _single_table(ctx, base: str, metrics: list[str], dimensions: list[str], filters: list[str]) -> DataFrame:
    """Metrics of one table: filters and dimensions of other tables come over many-to-one relationships
    (left joins, so no row is doubled), and every filter applies before the aggregation."""
    df = MODEL[base].source(ctx)
    joined: dict[str, str] = {base: ""}
    out_dims = []
    for f in filters:
        if filter_table(f) == base:
            df = df.filter(named_filter(ctx, f))

    def reach(df: DataFrame, t: str) -> DataFrame:
        path = [] if t in joined else _path(base, t)
        if path is None:
            raise ValueError(f"no many-to-one path from {base} to {t}")
        for (lt, rt, lc, rc) in path:
            if rt in joined:
                continue
            prefix = f"_{rt}__"
            own = {f: named_filter(ctx, f) for f in filters if filter_table(f) == rt}
            right = MODEL[rt].source(ctx).withColumns(own) if own else MODEL[rt].source(ctx)
            needed = ({rc} | set(MODEL[rt].dimensions.values()) | set(MODEL[rt].time_dimensions.values())
                      | {r[2] for r in RELATIONSHIPS if r[0] == rt} | set(own))
            right = right.select(*[c(x).alias(prefix + x) for x in right.columns if x in needed])
            left_key = c(lc) if lt == base else c(f"_{lt}__{lc}")
            df = df.join(right, left_key == c(prefix + rc), "left")
            joined[rt] = prefix
        return df

    for f in filters:
        t = filter_table(f)
        if t != base:
            df = reach(df, t)
            df = df.filter(c(joined[t] + f))
    for d in dimensions:
        t, col, name, grain = _dimension_column(base, d)
        df = reach(df, t)
        expr = c(joined[t] + col)
        if grain:
            expr = F.date_trunc(grain, expr)
        out_dims.append(expr.alias(name))
    aggs = [metric(ctx, m) for m in metrics]
    return df.groupBy(*out_dims).agg(*aggs) if out_dims else df.agg(*aggs)


def metric_query(ctx, metrics: list[str], dimensions: list[str] | None = None,
                 filters: list[str] | None = None, order: list[Column] | None = None,
                 limit: int | None = None) -> DataFrame:
    """O-M0: metrics (or facts as ``table.fact``) grouped by dimensions, filtered by named filters.

    Every filter applies to every metric: a filter that a metric's table cannot reach over the
    relationships is an error, never left out."""
    dimensions = dimensions or []
    filters = filters or []
    by_table: dict[str, list[str]] = {}
    for m in metrics:
        by_table.setdefault(metric_table(m), []).append(m)
    for base in sorted(by_table, key=lambda t: t == "risk_flags"):
        MODEL[base].source(ctx)     # the flags are derived last, from the tables that are stored by then
    parts = []
    for base, ms in by_table.items():
        parts.append(_single_table(ctx, base, ms, dimensions, filters))
    dim_names = [_dimension_column(next(iter(by_table)), d)[2] for d in dimensions]
    if not dim_names:  # one row per part, disjoint columns: stack them and collapse to one row
        cols = [x for p in parts for x in p.columns]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return out.agg(*[F.max(x).alias(x) for x in cols])

    def combine(a: DataFrame, b: DataFrame) -> DataFrame:
        # null-safe full outer join on the shared dimensions (NULL is a group too)
        cond = reduce(lambda x, y: x & y, [a[d].eqNullSafe(b[d]) for d in dim_names])
        rest_a = [a[x] for x in a.columns if x not in dim_names]
        rest_b = [b[x] for x in b.columns if x not in dim_names]
        return a.join(b, cond, "full_outer").select(
            *[F.coalesce(a[d], b[d]).alias(d) for d in dim_names], *rest_a, *rest_b)

    out = reduce(combine, parts)
    if order:
        out = out.orderBy(*order)
    if limit:
        out = out.limit(limit)
    return out


def table_metrics(ctx, table: str) -> DataFrame:
    """All metrics of one table as one row."""
    return metric_query(ctx, list(MODEL[table].metrics))


def table_filter_counts(ctx, table: str) -> DataFrame:
    """One row: number of rows each named filter of ``table`` selects (one scan)."""
    m = MODEL[table]
    df = m.source(ctx)
    return df.agg(*[_cnt(fn(ctx)).alias(name) for name, fn in m.filters.items()])


def table_facts(ctx, table: str) -> DataFrame:
    """O-M21: every fact of a table with its default aggregation, one row."""
    m = MODEL[table]
    df = m.source(ctx)
    cols = [_fact_column(col, agg, name) for name, (col, agg) in m.facts.items()]
    return df.agg(*cols)
