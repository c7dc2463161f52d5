"""Documented policy rules (O-X1..O-X15).

The reference states these rules in its policy documents but never runs
them; each is a plain batch operator here.  Windowed rules (O-X9, O-X10)
use the bucketed range windows of :mod:`timewin` (no pair explosion).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.operators.timewin import range_sums
from ledgerguard.session import ts_lit

c = F.col


def sar_due_date(filings: DataFrame) -> DataFrame:
    """O-X1: 30 calendar days; 60 with no known subject; 90 for continuing activity."""
    days = (F.when(c("outcome") == "UNDER_INVESTIGATION", 90).when(c("customer_id").isNull(), 60).otherwise(30))
    return filings.withColumn("due_days", days).withColumn("sar_due_date", F.date_add(c("filing_date"), days))


def ctr_candidates(txns: DataFrame, threshold: float = 10000, due_days: int = 15) -> DataFrame:
    """O-X2: cash transactions above 10,000 need a CTR within 15 days."""
    t = txns.filter((c("txn_category") == "CASH") & (c("amount") > threshold))
    return t.withColumn("ctr_due_date", F.date_add(F.to_date(c("txn_ts")), due_days))


def sar_approval_tier(amount: Column, pep: Column, sanctioned: Column) -> Column:
    """O-X3: approver by amount and subject; NULL tier below the 5,000 mandatory line."""
    hot = F.coalesce(pep, F.lit(False)) | F.coalesce(sanctioned, F.lit(False))
    return (F.when(amount > 100000, "CHIEF_COMPLIANCE_OFFICER").when(hot, "CHIEF_COMPLIANCE_OFFICER")
            .when(amount >= 25000, "SENIOR_COMPLIANCE_MANAGER").otherwise("COMPLIANCE_OFFICER"))


def sar_approvals(filings: DataFrame, customers: DataFrame, mandatory_from: float = 5000) -> DataFrame:
    cu = customers.select("customer_id", "pep_flag", "sanction_flag")
    j = filings.join(cu, "customer_id", "left")
    return j.select("filing_id", "amount_involved",
                    (c("amount_involved") >= mandatory_from).alias("mandatory"),
                    sar_approval_tier(c("amount_involved"), c("pep_flag"), c("sanction_flag")).alias("approver"))


def sector_concentration(exposures: DataFrame, limit: float = 0.25) -> DataFrame:
    """O-X4: share of total outstanding per sector; breach above 25%."""
    by = exposures.groupBy("sector").agg(F.sum("outstanding").alias("outstanding"))
    # the grand total is one value: a scalar subquery, not a join
    j = by.withColumn("total", exposures.agg(F.sum("outstanding")).scalar())
    share = F.round(c("outstanding").cast("double") / c("total").cast("double"), 4)
    return j.select("sector", c("outstanding").cast("decimal(18,2)").alias("outstanding"),
                    share.alias("share"), (share > limit).alias("breach"))


def dpd_bucket(dpd: Column) -> Column:
    """O-X5: SMA-0 1-30, SMA-1 31-60, SMA-2 61-90, NPA above 90 days past due."""
    return (F.when(dpd <= 0, "CURRENT").when(dpd <= 30, "SMA-0").when(dpd <= 60, "SMA-1")
            .when(dpd <= 90, "SMA-2").otherwise("NPA"))


def dpd_classes(accounts: DataFrame, as_of: str) -> DataFrame:
    dpd = F.datediff(F.to_date(ts_lit(as_of)), c("last_txn_date"))
    return accounts.select("account_id", dpd.cast("bigint").alias("days_past_due"), dpd_bucket(dpd).alias("dpd_class"))


def npa_provision_rate(npa_class: Column, secured: Column, age_days: Column) -> Column:
    """O-X6: SUBSTANDARD 15% secured / 25% unsecured; DOUBTFUL 25% / 40% / 100% by age; LOSS 100%."""
    return (F.when(npa_class == "SUBSTANDARD", F.when(secured, 0.15).otherwise(0.25))
            .when(npa_class == "DOUBTFUL", F.when(age_days <= 365, 0.25).when(age_days <= 1095, 0.40).otherwise(1.0))
            .when(npa_class == "LOSS", 1.0).otherwise(0.0))


def npa_provisions(exposures: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    a = accounts.filter(c("npa_flag")).select("account_id", "npa_classification", "last_txn_date")
    j = exposures.join(a, "account_id")
    age = F.datediff(F.to_date(ts_lit(as_of)), c("last_txn_date"))
    rate = npa_provision_rate(c("npa_classification"), c("collateral_type") != "UNSECURED", age)
    return j.select("exposure_id", "npa_classification", rate.cast("decimal(5,2)").alias("provision_rate"),
                    F.round(c("outstanding") * rate.cast("decimal(5,2)"), 2).cast("decimal(18,2)").alias("provision"))


def lcr_with_inflow_cap(positions: DataFrame, early_warning: float = 0.95) -> DataFrame:
    """O-X7: HQLA / max(outflow - min(inflow, 75% outflow), 25% outflow); warning under 95%."""
    out = c("outflow").cast("double")
    net = out - F.least(c("inflow").cast("double"), out * 0.75)
    den = F.greatest(net, out * 0.25)
    ratio = F.round(F.try_divide((c("hqla_level1") + c("hqla_level2")).cast("double"), den), 4)
    return positions.select("position_id", ratio.alias("capped_lcr"),
                            F.coalesce(ratio < early_warning, F.lit(False)).alias("early_warning"))


def nsfr_early_warning(positions: DataFrame, level: float = 1.03) -> DataFrame:
    """O-X8: ALM escalation below 103% NSFR."""
    return positions.select("position_id", "nsfr_ratio",
                            F.coalesce(c("nsfr_ratio") < level, F.lit(False)).alias("nsfr_warning"))


def pass_through(txns: DataFrame, window: str = "48 hours", dense: DataFrame | None = None) -> DataFrame:
    """O-X9: structuring credits followed by debits on the same account within 48 hours.

    A forward range window over (account, time bucket): for each credit, the count and sum of
    debits in [t, t + 48h] - no credit x debit pairs are built."""
    is_debit = c("txn_type") == "DEBIT"
    asked = is_debit | ((c("txn_type") == "CREDIT") & c("is_structuring"))  # no other row is counted or returned
    t = range_sums(txns.filter(asked), ["account_id"], "txn_ts", window,
                   {"debits_48h": F.when(is_debit, 1).otherwise(0),
                    "debit_amount_48h": F.when(is_debit, c("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))},
                   direction="forward", dense=dense)
    return (t.filter((c("txn_type") == "CREDIT") & c("is_structuring") & (c("debits_48h") > 0))
             .select("txn_id", "account_id", "txn_ts", "amount", c("debits_48h").cast("bigint").alias("debits_48h"),
                     c("debit_amount_48h").cast("decimal(18,2)").alias("debit_amount_48h")))


def rolling_structuring(txns: DataFrame, window: str = "21 days", below: float = 10000,
                        min_count: int = 3, dense: DataFrame | None = None) -> DataFrame:
    """O-X10: at least ``min_count`` credits under 10,000 on one account within 21 days, with total."""
    sub = (c("txn_type") == "CREDIT") & (c("amount") < below)
    t = range_sums(txns.filter(sub), ["account_id"], "txn_ts", window,
                   {"n_sub": F.when(sub, 1).otherwise(0),
                    "sub_total": F.when(sub, c("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))}, dense=dense)
    return (t.filter(sub & (c("n_sub") >= min_count))
             .select("txn_id", "account_id", "txn_ts", c("n_sub").cast("bigint").alias("n_sub"),
                     c("sub_total").cast("decimal(18,2)").alias("sub_total")))


def capital_need(exposures: DataFrame) -> DataFrame:
    """O-X11: CET1 4.5%, Tier 1 6%, total capital 8% of RWA, per sector."""
    g = exposures.groupBy("sector").agg(F.sum("rwa").alias("rwa"))
    return g.select("sector", c("rwa").cast("decimal(18,2)").alias("rwa"),
                    *[F.round(c("rwa") * F.lit(p).cast("decimal(4,3)"), 2).cast("decimal(18,2)").alias(n)
                      for n, p in (("cet1_need", "0.045"), ("tier1_need", "0.060"), ("total_capital_need", "0.080"))])


def review_due(flags: DataFrame, score: float = 75) -> DataFrame:
    """O-X12: score above 75 -> mandatory review within 24 hours of the flag."""
    return flags.filter(c("flag_score") > score).select(
        "flag_id", "flag_score", (c("created_at") + F.expr("INTERVAL 24 HOURS")).alias("review_due_at"))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]; 0 when end <= start."""
    days = F.sequence(F.date_add(start, 1), end)
    return F.when(end > start, F.size(F.filter(days, lambda d: F.weekday(d) < 5))).otherwise(0)


def case_sla(cases: DataFrame, as_of: str, max_days: int = 5) -> DataFrame:
    """O-X13: open cases without an update for more than 5 business days."""
    bd = business_days_between(F.to_date(c("updated_at")), F.to_date(ts_lit(as_of)))
    k = cases.filter(~c("status").isin("RESOLVED", "CLOSED"))
    return k.select("case_id", "status", bd.cast("bigint").alias("business_days_idle"),
                    (bd > max_days).alias("sla_breach_calc"))


def add_business_days(d: Column, n: int = 2) -> Column:
    """Date plus ``n`` (1..5) business days (weekends skipped)."""
    wd = F.weekday(d)  # 0 = Monday .. 6 = Sunday
    return (F.when(wd == 5, F.date_add(d, n + 1)).when(wd == 6, F.date_add(d, n))
            .when(wd + n > 4, F.date_add(d, n + 2)).otherwise(F.date_add(d, n)))


def lcr_notification_due(positions: DataFrame) -> DataFrame:
    """O-X14: notify the supervisor within 2 business days of an LCR breach."""
    return positions.filter(c("lcr_breach")).select(
        "position_id", "position_date", add_business_days(c("position_date"), 2).alias("notify_by"))


def ifrs9_stage(pd: Column, npa: Column) -> Column:
    """O-X15: stage 3 if NPA or PD > 0.35; stage 2 if PD > 0.10; else stage 1."""
    return F.when(F.coalesce(npa, F.lit(False)) | (pd > 0.35), 3).when(pd > 0.10, 2).otherwise(1)


def ifrs9_stages(exposures: DataFrame, accounts: DataFrame) -> DataFrame:
    a = accounts.select("account_id", "npa_flag")
    j = exposures.join(a, "account_id", "left")
    return j.select("exposure_id", ifrs9_stage(c("pd_score"), c("npa_flag")).alias("stage"))
