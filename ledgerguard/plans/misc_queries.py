"""Registered entries for generators/sinks (O-S*), scalar families (O-FN*) and policy rules (O-X*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.functions.rules import rule_catalog_df, short_tip, unactioned
from ledgerguard.operators import rules_ext as X
from ledgerguard.operators.governance import Actor
from ledgerguard.plans.dashboard import filter_flags
from ledgerguard.plans.search_queries import bm25_top_k
from ledgerguard.sources import generate as GEN
from ledgerguard.sources import sinks as SK
from ledgerguard.sources.schemas import RISK_FLAGS_SCHEMA, conform, load
from ledgerguard.streaming.refresh import scratch_path
from ledgerguard.session import ts_lit

c = F.col


# ---- generators, literals, sinks --------------------------------------------------
def gen_labels(ctx) -> DataFrame:
    """O-S2: the demo generator's label rules over the event rows (row number = event_id + 1)."""
    ev = ctx.bank.raw("events")
    lab = GEN.injected_labels(c("event_id") + 1)
    return GEN.label_counts(ev.select(lab["fraud_pattern"].alias("fraud_pattern"),
                                      lab["is_flagged"].alias("is_flagged")))


def bucket_index(ctx) -> DataFrame:
    """O-S3 + O-J5-free lookup: the tenor list split into (value, 1-based idx), joined to positions."""
    b = GEN.split_to_rows(ctx.spark, ",".join(K.TENOR_BUCKETS)).withColumnRenamed("value", "tenor_bucket")
    p = ctx.liquidity_positions.groupBy("tenor_bucket").agg(F.count(F.lit(1)).alias("positions"))
    return p.join(F.broadcast(b), "tenor_bucket").select("idx", "tenor_bucket", "positions")


def rule_catalog_usage(ctx) -> DataFrame:
    """O-S5: flags per type against the literal rule catalog (constant-size broadcast side)."""
    cat = rule_catalog_df(ctx.spark).select("flag_type", "threshold_field", "threshold_limit")
    f = ctx.risk_flags.groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"))
    return f.join(F.broadcast(cat), "flag_type", "left").select(
        "flag_type", "n", c("threshold_field").alias("catalog_field"), c("threshold_limit").alias("catalog_limit"))


def generated_transactions(ctx) -> DataFrame:
    """O-S2, O-W1: the row generator at the size of the event table: rows and accounts by label and country."""
    g = GEN.generate_transactions(ctx.spark, ctx.bank.raw("events").count())     # one number
    return g.groupBy("fraud_pattern", "country_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("account_id").alias("accounts"))


def flag_tips(ctx) -> DataFrame:
    """O-D26: the short explanation that stands beside each flag type, with its flags."""
    return (ctx.risk_flags.groupBy("flag_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(unactioned(c("flag_status"))).alias("unactioned"))
            .select("flag_type", short_tip(c("flag_type")).alias("tip"), "n", "unactioned"))


def flags_append(ctx) -> DataFrame:
    """O-S6: append the flag queue to a table partitioned by domain; read it back."""
    path = scratch_path(ctx.spark, "risk_flags")
    SK.append_table(ctx.risk_flags, path, ["flag_domain"])
    back = load(ctx.spark, path, "risk_flags")
    return back.groupBy("flag_domain", "flag_status").agg(F.count(F.lit(1)).alias("n"))


def backfill_positions(ctx, cut: str = "2024-01-16") -> DataFrame:
    """O-S7: positions are appended by date without their ratios, which are filled in later: first up to a date, then from it
    on; each run replaces only the dates it touches.  Positions, filled ratios and breaches by date."""
    path = scratch_path(ctx.spark, "positions")
    cols = ["position_id", "position_date", "lcr_ratio", "lcr_breach"]
    raw = ctx.bank.liquidity_positions
    schema = ctx.derived_liquidity_positions.select(*cols).schema
    SK.append_table(conform(raw.select("position_id", "position_date"), schema), path, ["position_date"])
    for part in (c("position_date") < F.lit(cut).cast("date"), c("position_date") >= F.lit(cut).cast("date")):
        SK.backfill_table(ctx.derived_liquidity_positions.filter(part).select(*cols), path, ["position_date"])
    back = ctx.spark.read.schema(schema).parquet(path)
    return back.groupBy("position_date").agg(F.count(F.lit(1)).alias("n"), F.count("lcr_ratio").alias("filled"),
                                             F.count_if("lcr_breach").alias("breaches"))


def export_flags_csv(ctx) -> DataFrame:
    """O-S8: CSV export of the filtered flag queue (capped at 500 rows), read back."""
    path = scratch_path(ctx.spark, "flags-csv")
    cols = ["flag_id", "flag_domain", "flag_type", "severity", "flag_score"]
    SK.export_csv(filter_flags(ctx.risk_flags, limit=None).select(*cols), path, limit=500)
    schema = "flag_id long, flag_domain string, flag_type string, severity string, flag_score decimal(5,2)"
    return ctx.spark.read.option("header", True).schema(schema).csv(path)


def export_audit_csv(ctx) -> DataFrame:
    """O-S8 (audit half): the filtered audit timeline written as CSV with a header, read back."""
    from ledgerguard.plans.dashboard import audit_timeline
    path = scratch_path(ctx.spark, "audit-csv")
    SK.export_csv(audit_timeline(ctx.audit_log, action_types=["FLAG_ACCOUNT"], limit=None), path)
    schema = ("log_id long, actor_user string, actor_role string, action_type string, object_type string, "
              "object_id string, change_summary string, et string")
    return ctx.spark.read.option("header", True).schema(schema).csv(path)


def export_results_json(ctx) -> DataFrame:
    """O-S10: question-run results as JSON lines plus a summary; the summary read back."""
    path = scratch_path(ctx.spark, "run-json")
    res = bm25_top_k(ctx)
    summary = res.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best_score"))
    SK.export_json(res, path, summary)
    return ctx.spark.read.schema("query_id long, hits long, best_score double").json(f"{path}/summary")


# ---- scalar function families ------------------------------------------------------
def fn_string(ctx):
    cu = ctx.customers
    return cu.select(
        "customer_id",
        F.concat(F.upper("segment"), F.lit("-"), F.lower("kyc_status")).alias("tag"),
        F.expr("char(65 + customer_id % 26)").alias("letter"),
        F.lpad(c("customer_id").cast("string"), 8, "0").alias("padded"),
        F.left(c("full_name"), F.lit(8)).alias("name8"),
        F.right(c("national_id"), F.lit(4)).alias("id4"),
        F.split_part(c("email"), F.lit("@"), F.lit(2)).alias("domain"))


def fn_math(ctx):
    e = ctx.credit_exposures
    return e.select(
        "exposure_id", (c("exposure_id") % 7).alias("m7"), F.pmod(c("exposure_id") - 100, F.lit(7)).alias("pm7"),
        F.round(c("pd_score") * 100, 1).cast("decimal(10,1)").alias("pd_pct"),
        F.least(c("pd_score"), c("lgd")).alias("low"),
        (c("ead") - c("outstanding")).cast("decimal(18,2)").alias("headroom"))


def fn_null(ctx):
    a = ctx.accounts
    return a.select("account_id", F.coalesce(c("credit_limit"), F.lit(0)).cast("decimal(18,2)").alias("limit0"),
                    F.nullif(c("status"), F.lit("ACTIVE")).alias("non_active"),
                    c("utilisation_pct").isNull().alias("no_util"))


def fn_random(ctx):
    """O-FN4: seeded uniform draws and uuids: only their counts and ranges are engine-independent."""
    t = ctx.bank.transactions.select(F.rand(42).alias("u"), F.expr("uuid()").alias("id"))
    return t.agg(F.count(F.lit(1)).alias("n"),
                 F.count_if((c("u") >= 0) & (c("u") < 1)).alias("in_range"),
                 F.count_if(F.length("id") == 36).alias("uuid_shaped"))


def fn_date(ctx):
    t = ctx.bank.transactions
    return t.select("txn_id", F.date_add(F.to_date("txn_ts"), 30).alias("plus30"),
                    (c("txn_ts") + F.expr("INTERVAL 2 HOURS")).alias("plus2h"),
                    F.dayofmonth("txn_ts").cast("bigint").alias("dom"), F.hour("txn_ts").cast("bigint").alias("hr"),
                    F.datediff(F.to_date(ts_lit(ctx.as_of)), F.to_date("txn_ts")).cast("bigint").alias("age_days"),
                    F.date_trunc("hour", c("txn_ts")).alias("hour_start"))


def fn_array(ctx):
    k = ctx.cases
    return k.select("case_id", F.element_at("tags", 1).alias("first_tag"), F.get("tags", 1).alias("second_tag"),
                    F.size("tags").cast("bigint").alias("n_tags"), F.array_contains("tags", "FRAUD").alias("is_fraud"),
                    F.array_join("evidence_txn_ids", ";").alias("evidence"))


def fn_json(ctx):
    ev = ctx.bank.raw("events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                     F.from_json("props", "k int")["k"].alias("k2"),
                     F.to_json(F.struct("event_id", "event_type")).alias("j"))


def fn_context(ctx, actor: Actor = Actor("risk.manager" + K.BANK_DOMAIN, K.ROLE_MANAGER)):
    """O-FN8: CURRENT_USER / CURRENT_ROLE as an explicit actor."""
    a = ctx.audit_log
    return a.groupBy((c("actor_user") == F.lit(actor.user)).alias("by_me"),
                     (c("actor_role") == F.lit(actor.role)).alias("my_role")).agg(F.count(F.lit(1)).alias("n"))


# ---- policy rules ------------------------------------------------------------------
def x1(ctx):
    return X.sar_due_date(ctx.filings.filter(c("filing_type") == "SAR")).select(
        "filing_id", "filing_date", "due_days", "sar_due_date")


def x2(ctx):
    return X.ctr_candidates(ctx.transactions).select("txn_id", "amount", "ctr_due_date")


def x3(ctx):
    return X.sar_approvals(ctx.filings, ctx.customers)


def x4(ctx):
    return X.sector_concentration(ctx.credit_exposures)


def x5(ctx):
    return X.dpd_classes(ctx.accounts, ctx.as_of)


def x6(ctx):
    return X.npa_provisions(ctx.credit_exposures, ctx.accounts, ctx.as_of)


def x7(ctx):
    return X.lcr_with_inflow_cap(ctx.liquidity_positions)


def x8(ctx):
    return X.nsfr_early_warning(ctx.liquidity_positions)


def x9(ctx):
    return X.pass_through(ctx.transactions, dense=ctx.account_density)


def x10(ctx):
    return X.rolling_structuring(ctx.transactions, dense=ctx.account_density)


def x11(ctx):
    return X.capital_need(ctx.credit_exposures)


def x12(ctx):
    return X.review_due(ctx.risk_flags)


def x13(ctx):
    return X.case_sla(ctx.cases, ctx.as_of)


def x14(ctx):
    return X.lcr_notification_due(ctx.liquidity_positions)


def x15(ctx):
    return X.ifrs9_stages(ctx.credit_exposures, ctx.accounts)


ENTRIES = {
    "gen_labels": gen_labels, "bucket_index": bucket_index, "rule_catalog_usage": rule_catalog_usage,
    "flags_append": flags_append, "generated_transactions": generated_transactions, "flag_tips": flag_tips, "backfill_positions": backfill_positions, "export_flags_csv": export_flags_csv, "export_audit_csv": export_audit_csv, "export_results_json": export_results_json,
    "fn_string": fn_string, "fn_math": fn_math, "fn_null": fn_null, "fn_random": fn_random, "fn_date": fn_date,
    "fn_array": fn_array, "fn_json": fn_json, "fn_context": fn_context,
}
ENTRIES.update({f"x{i}": globals()[f"x{i}"] for i in range(1, 16)})
