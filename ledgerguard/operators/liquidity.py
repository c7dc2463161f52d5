"""Liquidity ratios and flags (O-D19..O-D25, O-D30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions.rules import rationale
from ledgerguard.operators.credit import fill_columns
from ledgerguard.session import ts_lit
from ledgerguard.sources.schemas import RISK_FLAGS_SCHEMA, conform

LIQUIDITY_ID_BASE = 3_000_000_000_000_000


def ratio(num: Column, den: Column) -> Column:
    """Unrounded num / den as double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_4dp(num: Column, den: Column) -> Column:
    """O-D19: round(num / nullif(den, 0), 4)."""
    return F.round(ratio(num, den), 4).cast("decimal(18,4)")


def derive_liquidity(positions: DataFrame) -> DataFrame:
    """O-D19, O-D20, O-D30.  ``lcr_breach`` uses the *unrounded* ratio; NULL ratio is no breach."""
    c = F.col
    hqla = (c("hqla_level1") + c("hqla_level2")).cast("decimal(18,2)")
    num = F.coalesce(c("lcr_numerator"), hqla) if "lcr_numerator" in positions.columns else hqla
    derived = {
        "net_position": (c("inflow") - c("outflow")).cast("decimal(18,2)"),
        "hqla_total": hqla,
        "lcr_numerator": num,
        "lcr_ratio": ratio_4dp(num, c("lcr_denominator")),
        "lcr_breach": F.coalesce(ratio(num, c("lcr_denominator")) < 1.0, F.lit(False)),
        "nsfr_breach": F.coalesce(c("nsfr_ratio") < 1.0, F.lit(False)),
    }
    return fill_columns(positions, derived)


def liquidity_payload() -> Column:
    """O-D27: 13-key evidence object."""
    c = F.col
    return F.to_json(F.struct(
        c("position_date").cast("string").alias("position_date"), c("tenor_bucket"),
        F.round(c("lcr_ratio"), 4).alias("lcr_ratio"), c("lcr_numerator"), c("lcr_denominator"),
        F.round(c("nsfr_ratio"), 4).alias("nsfr_ratio"), c("hqla_level1"), c("hqla_level2"),
        c("inflow"), c("outflow"), c("stress_scenario"), c("lcr_breach"), c("nsfr_breach")))


def build_liquidity_flags(positions: DataFrame, as_of: str = "2024-01-31 00:00:00") -> DataFrame:
    """O-D21..O-D25: one flag per breaching (date, bucket, scenario) row."""
    c = F.col
    lcr, nsfr, r = c("lcr_breach"), c("nsfr_breach"), c("lcr_ratio")
    p = positions.filter(lcr | nsfr)
    flag_type = F.when(lcr & nsfr, "DUAL_BREACH").when(lcr, "LCR_BREACH").otherwise("NSFR_BREACH")
    severity = F.when((r < 0.80) | (lcr & nsfr), "CRITICAL").when(r < 0.90, "HIGH").otherwise("MEDIUM")
    score = F.when(r < 0.80, 95).when(r < 0.90, 82).when(r < 1.00, 67).otherwise(58).cast("decimal(5,2)")
    now = ts_lit(as_of)
    out = p.select(
        (F.lit(LIQUIDITY_ID_BASE) + c("position_id")).alias("flag_id"),
        F.lit("LIQUIDITY").alias("flag_domain"),
        flag_type.alias("flag_type"),
        severity.alias("severity"),
        F.lit("OPEN").alias("flag_status"),
        F.lit(None).cast("long").alias("customer_id"),
        F.lit(None).cast("long").alias("account_id"),
        F.lit(None).cast("string").alias("txn_id"),
        F.when(lcr, "lcr_ratio").otherwise("nsfr_ratio").alias("threshold_field"),
        F.when(lcr, F.round(r, 4)).otherwise(F.round(c("nsfr_ratio"), 4)).cast("decimal(14,4)").alias("threshold_value"),
        F.lit(1.0).cast("decimal(14,4)").alias("threshold_limit"),
        rationale(flag_type).alias("threshold_rationale"),
        liquidity_payload().alias("evidence_payload"),
        score.alias("flag_score"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return conform(out, RISK_FLAGS_SCHEMA)
