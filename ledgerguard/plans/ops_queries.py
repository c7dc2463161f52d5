"""Registered entries for governance (O-G*), data quality (O-DQ*) and actions (O-B*).

Action request batches are derived from the data, so their size grows with it:
SAR requests for every CRITICAL flag (plus a second request for every
CROSS_BORDER flag, which exercises de-duplication), freeze requests for every
account with a confirmed-fraud review, escalations for every CRITICAL case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.operators import actions as A
from ledgerguard.operators import governance as G
from ledgerguard.operators import quality as DQ
from ledgerguard.session import cut_lineage

c = F.col
OFFICER = G.Actor("compliance.officer" + K.BANK_DOMAIN, K.ROLE_COMPLIANCE)
COMMITTEE = "risk.committee" + K.BANK_DOMAIN
DUP_OFFSET = 10_000_000_000_000_000


def _tables(ctx) -> dict[str, DataFrame]:
    return {"customers": ctx.customers, "accounts": ctx.accounts, "transactions": ctx.transactions,
            "credit_exposures": ctx.credit_exposures, "liquidity_positions": ctx.liquidity_positions,
            "regulatory_filings": ctx.filings, "case_escalations": ctx.cases, "audit_log": ctx.audit_log,
            "risk_flags": ctx.risk_flags, "policy_docs": ctx.policy_docs}


# ---- governance --------------------------------------------------------------
def masked_customers(role: str):
    def q(ctx):
        v = G.secure_view("customers", ctx.customers, G.Actor(f"user@{role.lower()}", role))
        return v.select("customer_id", "full_name", "national_id", "segment")
    return q


def masked_accounts(role: str):
    def q(ctx):
        v = G.secure_view("accounts", ctx.accounts, G.Actor(f"user@{role.lower()}", role))
        return v.select("account_id", "account_number", "status")
    return q


def filings_rowfilter(role: str, user: str):
    def q(ctx):
        return G.secure_view("regulatory_filings", ctx.filings, G.Actor(user, role)).select(
            "filing_id", "assigned_to", "filing_type")
    return q


def audit_authorization(ctx) -> DataFrame:
    return G.audit_authorization(ctx.spark, ctx.audit_log)


# ---- data quality ---------------------------------------------------------------
def _profile(ctx) -> DataFrame:
    """Counts and domain checks of all tables: observed for those that were stored, one scan each for the others."""
    if "dq_profile" not in ctx.__dict__:
        tables = _tables(ctx)
        ctx.dq_profile = cut_lineage(DQ.profile(tables, ctx.observed))
    return ctx.dq_profile


def dq_counts(ctx):
    return DQ.row_counts(_profile(ctx))


def dq_keys(ctx):
    return DQ.duplicate_keys(_tables(ctx))


def dq_orphans(ctx):
    return DQ.orphans(_tables(ctx))


def dq_domains(ctx):
    return DQ.domain_violations(_profile(ctx))


def dq_masking(ctx):
    return DQ.masking_coverage(_tables(ctx))


def dq_conversation_turns(ctx):
    return DQ.conversation_turn_gaps(ctx.bank.raw("conversations"))


# ---- actions ------------------------------------------------------------------
def sar_requests(ctx) -> DataFrame:
    f = ctx.risk_flags
    first = f.filter(c("severity") == "CRITICAL").select(
        c("flag_id").alias("request_id"), "flag_id",
        F.when(c("flag_domain") == "FRAUD", F.lit("auto-filed")).alias("notes"))
    again = f.filter(c("flag_type") == "CROSS_BORDER").select(
        (c("flag_id") + F.lit(DUP_OFFSET)).alias("request_id"), "flag_id", F.lit(None).cast("string").alias("notes"))
    return first.unionByName(again)


def _once(ctx, name: str, run) -> A.ActionResult:
    """A batch is run once per context; every entry about it reads the same run."""
    runs = ctx.__dict__.setdefault("_action_runs", {})
    if name not in runs:
        runs[name] = run()
    return runs[name]


def _sar(ctx) -> A.ActionResult:
    return _once(ctx, "sar", lambda: A.file_sar_drafts(
        ctx.risk_flags, ctx.filings, ctx.audit_log, sar_requests(ctx), OFFICER, ctx.as_of))


def sar_responses(ctx):
    """O-B5: the JSON object that answers each request."""
    return _sar(ctx).responses.select("request_id", "response")


def sar_batch(ctx):
    return _sar(ctx).responses.drop("response")


def sar_filings(ctx):
    return _sar(ctx).new_rows.select("filing_id", "customer_id", "account_id", "filing_status", "narrative",
                                     "risk_score", "reference_case_id", "filed_by")


def sar_flag_state(ctx):
    return (_sar(ctx).state.groupBy("flag_domain", "flag_status", "action_taken")
            .agg(F.count(F.lit(1)).alias("n")))


def sar_audit_rows(ctx):
    return _sar(ctx).audit.select("log_id", "actor_role", "action_type", "object_type", "object_id",
                                  "after_state", "change_summary")


def freeze_requests(ctx) -> DataFrame:
    f = ctx.risk_flags.filter((c("flag_domain") == "FRAUD") & (c("flag_status") == "CONFIRMED_FRAUD"))
    g = f.groupBy("account_id").agg(F.min("flag_id").alias("linked_flag_id"))
    return g.select(c("linked_flag_id").alias("request_id"), "account_id",
                    F.lit("Confirmed fraud under review").alias("reason"), "linked_flag_id")


def _freeze(ctx) -> A.ActionResult:
    return _once(ctx, "freeze", lambda: A.flag_accounts(
        ctx.accounts, ctx.cases, ctx.audit_log, freeze_requests(ctx), OFFICER, ctx.as_of))


def freeze_responses(ctx):
    """O-B5: the JSON object that answers each request."""
    return _freeze(ctx).responses.select("request_id", "response")


def freeze_batch(ctx):
    return _freeze(ctx).responses.drop("response")


def freeze_cases(ctx):
    return _freeze(ctx).new_rows.select("case_id", "customer_id", "account_id", "linked_flag_id",
                                        "linked_filing_id", "status", "resolution_notes")


def escalate_requests(ctx) -> DataFrame:
    return ctx.cases.filter(c("severity") == "CRITICAL").select(
        c("case_id").alias("request_id"), "case_id", F.lit(COMMITTEE).alias("escalate_to"),
        c("case_type").alias("notes"))


def _escalate(ctx) -> A.ActionResult:
    return _once(ctx, "escalate", lambda: A.escalate_cases(
        ctx.cases, ctx.audit_log, escalate_requests(ctx), OFFICER, ctx.as_of))


def escalate_responses(ctx):
    """O-B5: the JSON object that answers each request."""
    return _escalate(ctx).responses.select("request_id", "response")


def escalate_batch(ctx):
    return _escalate(ctx).responses.drop("response")


def escalate_state(ctx):
    return _escalate(ctx).state.select("case_id", "status", "escalated_to", "resolution_notes")


def audit_replay(ctx):
    return A.replay_state(ctx.audit_log).drop("after_state")


def audit_replay_tail(ctx):
    """O-B6 from a snapshot: the log comes in three parts by its ids; the first is replayed whole, the others advance
    the stored state, each reading only its own rows."""
    log = ctx.audit_log
    low, high = log.agg(F.min("log_id"), F.max("log_id")).first()     # two numbers
    first, second = (low + (high - low) * x // 3 for x in (1, 2))
    snapshot = A.ReplaySnapshot.of(log.filter(c("log_id") <= first)).advanced(log.filter(c("log_id") <= second))
    return snapshot.current(log).drop("after_state")


def _chain(ctx) -> tuple[A.ActionResult, A.ActionResult, A.ActionResult]:
    """SAR, then freezing the SAR'd accounts, then escalating the cases the freeze opened; each step numbers its
    audit rows from the log that the one before left."""
    sar = _sar(ctx)
    log = A.audit_append(ctx.audit_log, sar.audit)
    filed = sar.new_rows.filter(c("account_id").isNotNull())
    freeze_req = (filed.groupBy("account_id").agg(F.min("filing_id").alias("request_id"),
                                                   F.min_by("reference_case_id", "filing_id").alias("reference_case_id"))
                  .select("request_id", "account_id",
                          F.concat(F.lit("SAR "), c("reference_case_id")).alias("reason"),
                          F.lit(None).cast("bigint").alias("linked_flag_id")))
    frz = A.flag_accounts(ctx.accounts, ctx.cases, log, freeze_req, OFFICER, ctx.as_of)
    cases_now = ctx.cases.unionByName(frz.new_rows.select(*ctx.cases.columns))
    esc_req = frz.new_rows.select(c("case_id").alias("request_id"), "case_id",
                                  F.lit(COMMITTEE).alias("escalate_to"), F.lit(None).cast("string").alias("notes"))
    esc = A.escalate_cases(cases_now, A.audit_append(log, frz.audit), esc_req, OFFICER, ctx.as_of)
    return sar, frz, esc


def _chain_once(ctx):
    return _once(ctx, "chain", lambda: _chain(ctx))


def action_chain(ctx):
    """O-B7: accepted and rejected requests of the chain."""
    sar, frz, esc = _chain_once(ctx)

    def tally(step: str, res: A.ActionResult) -> DataFrame:
        return res.responses.agg(F.count_if(c("status") == "ok").alias("accepted"),
                                 F.count_if(c("status") == "error").alias("rejected")).select(
            F.lit(step).alias("step"), "accepted", "rejected")
    return tally("1_FILE_SAR", sar).unionByName(tally("2_FLAG_ACCOUNT", frz)).unionByName(
        tally("3_ESCALATE_CASE", esc))


def action_chain_audit(ctx):
    """O-B4, O-B7: the appended log after the chain: rows and id range of each action's new rows, and how many
    ids of the whole log occur more than once."""
    log = A.audit_append(ctx.audit_log, *[step.audit for step in _chain_once(ctx)])
    last = ctx.audit_log.agg(F.max("log_id")).scalar()
    repeated = log.groupBy("log_id").count().filter(c("count") > 1).agg(F.count(F.lit(1))).scalar()
    return (log.filter(c("log_id") > last).groupBy("action_type")
            .agg(F.count(F.lit(1)).alias("n"), F.min("log_id").alias("first_id"), F.max("log_id").alias("last_id"))
            .select("*", repeated.alias("repeated_ids")))


def sar_denied(ctx):
    """O-G7: the SAR batch sent by an analyst: every request is refused, nothing is written."""
    actor = G.Actor("analyst.1" + K.BANK_DOMAIN, K.ROLE_ANALYST)
    res = A.file_sar_drafts(ctx.risk_flags, ctx.filings, ctx.audit_log, sar_requests(ctx), actor, ctx.as_of)
    return res.responses.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


ENTRIES = {}
for _r in K.ALL_ROLES:
    ENTRIES[f"masked_customers_{_r.lower()}"] = masked_customers(_r)
    ENTRIES[f"masked_accounts_{_r.lower()}"] = masked_accounts(_r)
ENTRIES["filings_rowfilter_manager"] = filings_rowfilter(K.ROLE_MANAGER, "reviewer@partner.example")
ENTRIES["filings_rowfilter_analyst"] = filings_rowfilter(K.ROLE_ANALYST, "analyst.1" + K.BANK_DOMAIN)
ENTRIES["filings_rowfilter_auditor"] = filings_rowfilter(K.ROLE_AUDITOR, "auditor" + K.BANK_DOMAIN)
ENTRIES.update({
    "audit_authorization": audit_authorization,
    "dq_counts": dq_counts, "dq_keys": dq_keys, "dq_orphans": dq_orphans, "dq_domains": dq_domains,
    "dq_masking": dq_masking, "dq_conversation_turns": dq_conversation_turns,
    "sar_batch": sar_batch, "sar_filings": sar_filings, "sar_flag_state": sar_flag_state,
    "sar_audit_rows": sar_audit_rows, "freeze_batch": freeze_batch, "freeze_cases": freeze_cases,
    "escalate_batch": escalate_batch, "escalate_state": escalate_state, "audit_replay": audit_replay,
    "sar_responses": sar_responses, "freeze_responses": freeze_responses, "escalate_responses": escalate_responses,
    "audit_replay_tail": audit_replay_tail, "action_chain": action_chain, "action_chain_audit": action_chain_audit, "sar_denied": sar_denied,
})
