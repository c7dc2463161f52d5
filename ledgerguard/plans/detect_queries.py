"""Operator-level entries for the detection layer (O-D1..O-D30, O-W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.functions.rules import score_band
from ledgerguard.operators.fraud import (classify_fraud, detect_cross_border, detect_round_number, detect_structuring,
                                         detect_velocity)
from ledgerguard.operators import fraud as F_
from ledgerguard.operators.timewin import trailing_count
from ledgerguard.session import cut_lineage
from ledgerguard.streaming.refresh import scratch_path

c = F.col


def velocity(ctx) -> DataFrame:
    """O-D1 / O-W3: trailing-window count for every transaction."""
    v = detect_velocity(ctx.bank.transactions, window=ctx.velocity_window, dense=ctx.account_density)
    return v.select("txn_id", "account_id", "txn_ts", "velocity_count", "is_velocity")


def velocity_burst(ctx) -> DataFrame:
    """O-D1 with mark_burst: every member of a qualifying window."""
    v = detect_velocity(ctx.bank.transactions, window=ctx.velocity_window, mark_burst=True, dense=ctx.account_density)
    return v.select("txn_id", "account_id", "velocity_count", "is_velocity", "is_velocity_burst")


def velocity_dense(ctx) -> DataFrame:
    """O-W3 with granules of two rows: every account with more in a window is cut, the counts are the same."""
    v = trailing_count(ctx.bank.transactions, ["account_id"], "txn_ts", ctx.velocity_window, "velocity_count",
                       dense=ctx.account_density, rows_per_granule=2)
    return v.select("txn_id", "account_id", "txn_ts", "velocity_count")


def velocity_hour(ctx, n: int = 3) -> DataFrame:
    """O-D1 by the documented window of one hour, with the least count that the fixture reaches."""
    v = detect_velocity(ctx.bank.transactions, n=n, window=K.VELOCITY_WINDOW, dense=ctx.account_density)
    return v.filter("is_velocity").select("txn_id", "account_id", "txn_ts", "velocity_count")


def _rule_hits(detected: DataFrame, col: str) -> DataFrame:
    """A single row rule on the scan: its filter reaches the source's own columns, no window is computed."""
    return detected.filter(c(col)).select("txn_id", "account_id", "amount", "country_code", c(col).alias("hit"))


def structuring(ctx) -> DataFrame:
    """O-D2 / O-P2."""
    return _rule_hits(detect_structuring(ctx.bank.transactions), "is_structuring")


def cross_border(ctx) -> DataFrame:
    """O-D3 / O-P3."""
    return _rule_hits(detect_cross_border(ctx.bank.transactions), "high_risk_country")


def round_number(ctx) -> DataFrame:
    """O-D4."""
    return _rule_hits(detect_round_number(ctx.bank.transactions), "is_round_number")


def classify(ctx) -> DataFrame:
    """O-D5..O-D7 for every transaction."""
    t = ctx.derived_transactions
    return t.select("txn_id", "fraud_pattern", F.array_join(c("patterns"), ",").alias("pattern_list"),
                    "is_flagged", "flag_score", "review_status", "reviewed_by")


def classify_summary(ctx) -> DataFrame:
    """O-Q24-style distribution of primary patterns and review states."""
    t = ctx.derived_transactions
    return (t.groupBy("fraud_pattern", "review_status")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount")))


def flag_id_registry(ctx) -> DataFrame:
    """O-A14, O-D28: flags of transactions with text ids.  Ids are registered in two batches, first for the transactions
    up to the middle of the month, then for all; flags, their ids, ids that two transactions share, and ids that the second batch
    moved, by pattern."""
    t = ctx.transactions.withColumn("txn_id", F.concat(F.lit("tx-"), F.md5("txn_id")))
    registry = F_.flag_id_registry(ctx.spark, scratch_path(ctx.spark, "flag-ids"))
    first = cut_lineage(F_.register_flag_ids(t.filter("txn_ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"), registry))
    ids = F_.register_flag_ids(t, registry)
    flags = F_.build_fraud_flags(t, ctx.accounts, ctx.as_of, ids)
    before = first.select(c("key").alias("txn_id"), c("id").alias("before"))
    shared = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1))).scalar()
    return (flags.join(before, "txn_id", "left").groupBy("flag_type")
            .agg(F.count(F.lit(1)).alias("n_flags"), F.countDistinct("flag_id").alias("n_ids"),
                 F.count_if(c("before") != c("flag_id")).alias("moved"))
            .select("*", shared.alias("shared")))


def fraud_flags(ctx) -> DataFrame:
    """O-D8, O-D9."""
    f = ctx.derived_fraud_flags
    return f.select("flag_id", "flag_type", "severity", "flag_status", "customer_id", "account_id", "txn_id",
                    "threshold_field", "threshold_value", "threshold_limit", "flag_score")


def credit_derive(ctx) -> DataFrame:
    """O-D10..O-D13."""
    e = ctx.derived_credit_exposures
    return e.select("exposure_id", "expected_loss", "rwa", "watch_list_flag", "utilisation_pct",
                    F.coalesce(c("utilisation_pct") > 90, F.lit(False)).alias("utilisation_breach"))


def credit_flags(ctx) -> DataFrame:
    """O-D14..O-D18 (O-J3: exposures with NULL account are kept)."""
    f = ctx.derived_credit_flags
    return f.select("flag_id", "flag_type", "severity", "customer_id", "account_id", "threshold_field",
                    "threshold_value", "threshold_limit", "flag_score")


def liquidity_ratios(ctx) -> DataFrame:
    """O-D19, O-D20, O-D30."""
    p = ctx.derived_liquidity_positions
    return p.select("position_id", "position_date", "tenor_bucket", "net_position", "hqla_total",
                    "lcr_numerator", "lcr_ratio", "lcr_breach", "nsfr_ratio", "nsfr_breach")


def liquidity_flags(ctx) -> DataFrame:
    """O-D21..O-D25."""
    f = ctx.derived_liquidity_flags
    return f.select("flag_id", "flag_type", "severity", "threshold_field", "threshold_value",
                    "threshold_limit", "flag_score")


def risk_flags(ctx) -> DataFrame:
    """O-D28 + O-D29: the unified queue with score bands."""
    f = ctx.derived_risk_flags
    return f.select("flag_id", "flag_domain", "flag_type", "severity", "flag_status", "customer_id",
                    "account_id", "txn_id", "threshold_field", "threshold_value", "threshold_limit",
                    "flag_score", score_band(c("flag_score")).alias("score_band"),
                    c("threshold_rationale").isNotNull().alias("has_rationale"))


def flag_payload_fields(ctx) -> DataFrame:
    """O-D27: re-extract typed fields from the JSON payload of the stored queue; count present keys.

    The payload is parsed once into a typed struct (decimals read exactly), not once per field."""
    f = ctx.risk_flags
    schema = ("amount decimal(18,2), channel string, txn_ts string, review_status string, exposure_id bigint, "
              "expected_loss decimal(18,2), rwa decimal(18,2), npa_flag boolean, tenor_bucket string, "
              "position_date date, lcr_ratio decimal(18,4)")
    p = f.select("flag_id", "flag_domain", F.size(F.json_object_keys(c("evidence_payload"))).alias("n_keys"),
                 F.from_json(c("evidence_payload"), schema).alias("p"))
    return p.select("flag_id", "flag_domain", "n_keys",
                    *[c(f"p.{x}").alias(f"p_{x}") for x in
                      ["amount", "channel", "txn_ts", "review_status", "exposure_id", "expected_loss", "rwa",
                       "npa_flag", "tenor_bucket", "position_date", "lcr_ratio"]])


def score_bands(ctx) -> DataFrame:
    """O-D29: flags per domain and score band."""
    f = ctx.risk_flags
    return (f.groupBy("flag_domain", score_band(c("flag_score")).alias("score_band"))
             .agg(F.count(F.lit(1)).alias("n")))


ENTRIES = {
    "flag_id_registry": flag_id_registry, "velocity": velocity, "velocity_dense": velocity_dense, "velocity_hour": velocity_hour,
    "velocity_burst": velocity_burst, "structuring": structuring,
    "cross_border": cross_border, "round_number": round_number, "classify_fraud": classify,
    "classify_summary": classify_summary, "fraud_flags": fraud_flags, "credit_derive": credit_derive,
    "credit_flags": credit_flags, "liquidity_ratios": liquidity_ratios, "liquidity_flags": liquidity_flags,
    "risk_flags": risk_flags, "flag_payload_fields": flag_payload_fields, "score_band": score_bands,
}
