"""Verified queries and dashboard / board queries (O-Q1..O-Q29).

Each function takes a :class:`RiskContext` and returns a lazily planned
DataFrame.  Rounded averages are taken over exact decimals (``avg`` of a
decimal stays decimal in Spark) before ``round``; every top-k has a unique
last sort key so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions.rules import severity_rank, unactioned
from ledgerguard.session import ts_lit

c = F.col
def MILLION() -> Column:
    return F.lit("0.000001").cast("decimal(7,6)")


def _as_of(ctx) -> Column:
    return ts_lit(ctx.as_of)


def _as_of_date(ctx) -> Column:
    return F.to_date(_as_of(ctx))


def _days_ago(ctx, n: int) -> Column:
    return _as_of(ctx) - F.expr(f"INTERVAL {n} DAYS")


def distinct_list(col: str) -> Column:
    """O-A7: ARRAY_AGG(DISTINCT x) as a sorted, comma-joined string (order-free)."""
    return F.array_join(F.sort_array(F.collect_set(c(col))), ",")


def avg_round(col: Column, scale: int, times: int = 1, out: str = "decimal(18,4)") -> Column:
    """round(avg(col) * times, scale) in exact decimal arithmetic."""
    return F.round(F.avg(col) * F.lit(times), scale).cast(out)


def millions(col: Column, scale: int) -> Column:
    """O-A10: round(sum / 1e6, scale), decimal throughout."""
    return F.round(F.sum(col) * MILLION(), scale).cast(f"decimal(18,{scale})")


# ---- O-Q1..O-Q8: the semantic model's verified queries ----------------------

def q1_fraud_accounts_this_week(ctx, days: int = 7, limit: int = 20) -> DataFrame:
    t = ctx.transactions.filter(c("is_flagged") & (c("txn_ts") >= _days_ago(ctx, days)))
    a = ctx.accounts.select("account_id", "customer_id", "account_type")
    cu = ctx.customers.select("customer_id", "segment")
    j = t.join(a, "account_id").join(cu, "customer_id")
    g = j.groupBy("account_id", "account_type", "segment").agg(
        F.count(F.lit(1)).alias("flagged_txn_count"),
        F.sum("amount").cast("decimal(18,2)").alias("total_flagged_amount"),
        F.max("flag_score").alias("max_flag_score"),
        distinct_list("fraud_pattern").alias("patterns"))
    return g.orderBy(c("max_flag_score").desc(), c("account_id")).limit(limit)


def q2_lcr_trend(ctx, days: int = 30, bucket: str = "0_7D") -> DataFrame:
    p = ctx.liquidity_positions.filter((c("position_date") >= F.date_sub(_as_of_date(ctx), days))
                                       & (c("tenor_bucket") == bucket))
    return (p.groupBy("position_date")
             .agg(avg_round(c("lcr_ratio"), 1, 100, "decimal(18,1)").alias("avg_lcr_pct"),
                  F.max(F.when(c("lcr_breach"), 1).otherwise(0)).alias("had_breach"))
             .orderBy("position_date"))


def q3_watch_list_by_sector(ctx) -> DataFrame:
    e = ctx.credit_exposures.filter(c("watch_list_flag"))
    return (e.groupBy("sector")
             .agg(F.count(F.lit(1)).alias("watch_list_count"),
                  millions(c("outstanding"), 2).alias("outstanding_millions"),
                  millions(c("rwa"), 2).alias("rwa_millions"),
                  avg_round(c("pd_score"), 2, 100, "decimal(18,2)").alias("avg_pd_pct"),
                  millions(c("expected_loss"), 4).alias("ecl_millions"))
             .orderBy(c("outstanding_millions").desc(), c("sector")))


def q4_high_risk_customers_fraud(ctx, days: int = 7, limit: int = 20) -> DataFrame:
    cu = ctx.customers.filter(c("risk_rating") == "HIGH").select(
        "customer_id", "segment", "risk_rating", "pep_flag", "sanction_flag")
    a = ctx.accounts.select("account_id", "customer_id")
    t = ctx.transactions.filter(c("is_flagged") & (c("txn_ts") >= _days_ago(ctx, days)))
    j = cu.join(a, "customer_id").join(t, "account_id")
    g = j.groupBy("customer_id", "segment", "risk_rating", "pep_flag", "sanction_flag").agg(
        F.countDistinct("txn_id").alias("flagged_txn_count"),
        F.max("flag_score").alias("max_fraud_score"),
        distinct_list("fraud_pattern").alias("fraud_patterns"))
    return g.orderBy(c("max_fraud_score").desc(), c("customer_id")).limit(limit)


def q5_open_flags_summary(ctx) -> DataFrame:
    f = ctx.risk_flags.filter(c("flag_status") == "OPEN")
    g = f.groupBy("flag_domain", "severity", "flag_type").agg(
        F.count(F.lit(1)).alias("flag_count"),
        avg_round(c("flag_score"), 1, 1, "decimal(18,1)").alias("avg_score"))
    return g.orderBy(severity_rank(c("severity")), c("flag_count").desc(), c("flag_domain"), c("flag_type"))


def q6_structuring_detail(ctx, limit: int = 50) -> DataFrame:
    t = ctx.transactions.filter(c("fraud_pattern") == "STRUCTURING")
    a = ctx.accounts.select("account_id", "customer_id")
    cu = ctx.customers.select("customer_id", "segment", "pep_flag")
    j = t.join(a, "account_id").join(cu, "customer_id")
    return (j.select("txn_id", "account_id", "customer_id", "segment", "pep_flag", "amount", "channel",
                     "txn_ts", "flag_score", "country_code")
             .orderBy(c("txn_ts").desc(), c("txn_id")).limit(limit))


def q7_rwa_by_sector_rating(ctx, limit: int = 30) -> DataFrame:
    e = ctx.credit_exposures
    g = e.groupBy("sector", "internal_rating").agg(
        F.count(F.lit(1)).alias("facility_count"),
        millions(c("outstanding"), 2).alias("outstanding_millions"),
        millions(c("rwa"), 2).alias("rwa_millions"),
        avg_round(c("pd_score"), 2, 100, "decimal(18,2)").alias("avg_pd_pct"))
    return g.orderBy(c("rwa_millions").desc(), c("sector"), c("internal_rating")).limit(limit)


def q8_lcr_breach_detail(ctx, limit: int = 50) -> DataFrame:
    p = ctx.liquidity_positions.filter(c("lcr_breach"))
    return (p.select("position_date", "tenor_bucket",
                     F.round(c("lcr_ratio") * 100, 1).cast("decimal(18,1)").alias("lcr_pct"),
                     F.round(c("lcr_numerator") * MILLION(), 1).cast("decimal(18,1)").alias("hqla_millions"),
                     F.round(c("lcr_denominator") * MILLION(), 1).cast("decimal(18,1)").alias("net_outflow_millions"),
                     "nsfr_breach", "lcr_ratio", "position_id")
             .orderBy(c("position_date").desc(), c("lcr_ratio").asc(), c("position_id"))
             .limit(limit)
             .drop("lcr_ratio", "position_id"))
