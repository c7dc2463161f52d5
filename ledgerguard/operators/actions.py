"""Set-based case actions with an append-only audit trail (O-B1..O-B7).

The reference runs one stored procedure call per action.  Here an action is a
batch job over a *DataFrame of requests*: gate by role, de-duplicate, validate
against current state, then emit

* ``new_rows``  - rows to append (filings / cases),
* ``state``     - the updated table (left join + coalesce; parquet has no UPDATE),
* ``audit``     - append-only audit rows, one per accepted request,
* ``responses`` - one JSON-able result row per request (ok or error).

Duplicate requests are resolved with an aggregation (first request id per
object wins), which combines map-side, so a hot object cannot pile up in one
task.  New ids continue after ``MAX(id)`` without a single-partition window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.operators.governance import CASE_ROLES, SAR_ROLES, Actor, role_gate
from ledgerguard.operators.ids import assign_sequential_ids, next_id
from ledgerguard.session import cut_lineage, ts_lit

c = F.col


@dataclass
class ActionResult:
    new_rows: DataFrame | None
    state: DataFrame
    audit: DataFrame
    responses: DataFrame


def _dedupe(requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """One row per object wins: the lowest request_id, and of equal ids one; the rest are rejected."""
    rows = cut_lineage(requests.withColumn("_lg_row", F.monotonically_increasing_id()))
    first = rows.groupBy(key).agg(F.min(F.struct("request_id", "_lg_row")).alias("_lg_first")).select("_lg_first._lg_row")
    winners = rows.join(first, "_lg_row", "left_semi").drop("_lg_row")
    losers = rows.join(first, "_lg_row", "left_anti").drop("_lg_row").withColumn(
        "error", F.lit(K.ERR_DUPLICATE))
    return winners, losers


def _audit_rows(accepted: DataFrame, audit_log: DataFrame, actor: Actor, as_of: str, action: str,
                object_type: str, object_id: Column, before: Column, after: Column, summary: Column) -> DataFrame:
    rows = accepted.select(
        "request_id",
        F.lit(actor.user).alias("actor_user"), F.lit(actor.role).alias("actor_role"),
        F.lit(action).alias("action_type"), F.lit(object_type).alias("object_type"),
        object_id.cast("string").alias("object_id"), before.alias("before_state"), after.alias("after_state"),
        summary.alias("change_summary"))
    rows = assign_sequential_ids(rows, "request_id", next_id(audit_log, "log_id"), "log_id")
    return rows.select("log_id", ts_lit(as_of).alias("event_ts"), "actor_user", "actor_role", "action_type",
                       "object_type", "object_id", "before_state", "after_state", "change_summary",
                       F.lit(None).cast("string").alias("source_ip"), F.lit(None).cast("string").alias("session_id"),
                       F.concat(F.lit("req-"), c("request_id").cast("string")).alias("request_id"))


def _responses(ok: DataFrame, errors: list[DataFrame], key: str, extra: dict[str, Column],
               body: dict[str, Column]) -> DataFrame:
    """One row per request; ``response`` is the JSON object that a caller of the single action gets: ``body`` for an
    accepted request, the error for a refused one."""
    good = ok.select("request_id", key, F.lit("ok").alias("status"), *[v.alias(k) for k, v in extra.items()],
                     F.lit(None).cast("string").alias("error"),
                     F.to_json(F.struct(*[v.alias(k) for k, v in body.items()])).alias("response"))
    out = good
    for e in errors:
        out = out.unionByName(e.select(
            "request_id", key, F.lit("error").alias("status"),
            *[F.lit(None).cast(good.schema[k].dataType).alias(k) for k in extra],
            "error", F.to_json(F.struct("error")).alias("response")))
    return out


def file_sar_drafts(flags: DataFrame, filings: DataFrame, audit_log: DataFrame, requests: DataFrame,
                    actor: Actor, as_of: str) -> ActionResult:
    """O-B1: requests (request_id, flag_id, notes) -> SAR drafts, ACTIONED flags, audit rows."""
    admitted, denied = role_gate(requests, actor, SAR_ROLES, K.ERR_SAR_ROLE)
    winners, dups = _dedupe(admitted, "flag_id")
    f = flags.select("flag_id", "flag_type", "flag_status", "customer_id", "account_id", "threshold_rationale",
                     "flag_score")
    j = winners.join(f, "flag_id", "left")
    missing = j.filter(c("flag_type").isNull() | c("flag_status").isin("ACTIONED", "DISMISSED")) \
        .withColumn("error", F.lit(K.ERR_FLAG))
    valid = j.filter(c("flag_type").isNotNull() & ~c("flag_status").isin("ACTIONED", "DISMISSED"))
    no_cust = valid.filter(c("customer_id").isNull()).withColumn("error", F.lit(K.ERR_NO_CUSTOMER))
    ok = valid.filter(c("customer_id").isNotNull())
    # ids are assigned once; every output below reads the same snapshot of the accepted batch
    ok = assign_sequential_ids(ok, "request_id", next_id(filings, "filing_id"), "filing_id")
    notes = F.when(c("notes").isNotNull(), F.concat(F.lit(". Notes: "), c("notes"))).otherwise(F.lit(""))
    narrative = F.concat(F.lit("SAR drafted from risk flag "), c("flag_id").cast("string"), F.lit(". Flag: "),
                         c("flag_type"), F.lit(". Regulatory basis: "),
                         F.coalesce(c("threshold_rationale"), F.lit("")), notes)
    today = F.to_date(ts_lit(as_of))
    new_filings = ok.select(
        "filing_id", "customer_id", "account_id",
        F.lit("SAR").alias("filing_type"), F.lit("DRAFT").alias("filing_status"), today.alias("filing_date"),
        F.lit(None).cast("date").alias("submitted_date"), F.lit(None).cast("string").alias("regulatory_body"),
        F.lit(actor.user).alias("filed_by"), F.lit(actor.user).alias("assigned_to"), narrative.alias("narrative"),
        F.lit(None).cast("array<string>").alias("linked_txn_ids"),
        F.lit(None).cast("decimal(18,2)").alias("amount_involved"),
        F.coalesce(c("flag_score"), F.lit(0)).cast("decimal(5,2)").alias("risk_score"),
        F.lit("FILED").alias("outcome"),
        F.concat(F.lit("SAR-FLAG-"), c("flag_id").cast("string")).alias("reference_case_id"),
        ts_lit(as_of).alias("created_at"), ts_lit(as_of).alias("updated_at"))
    upd = ok.select("flag_id", F.lit(True).alias("_lg_hit"))
    state = (flags.join(upd, "flag_id", "left")
             .withColumn("flag_status", F.when(c("_lg_hit"), F.lit("ACTIONED")).otherwise(c("flag_status")))
             .withColumn("action_taken", F.when(c("_lg_hit"), F.lit("SAR_FILED")).otherwise(c("action_taken")))
             .withColumn("actioned_by", F.when(c("_lg_hit"), F.lit(actor.user)).otherwise(c("actioned_by")))
             .withColumn("updated_at", F.when(c("_lg_hit"), ts_lit(as_of)).otherwise(c("updated_at")))
             .drop("_lg_hit"))
    audit = _audit_rows(ok, audit_log, actor, as_of, "FILE_SAR", "FILING", c("filing_id"), F.lit(None).cast("string"),
                        F.to_json(F.struct("filing_id", "flag_id")),
                        F.concat(F.lit("SAR filed from flag_id="), c("flag_id").cast("string"),
                                 F.lit(" filing_id="), c("filing_id").cast("string")))
    responses = _responses(ok, [denied, dups, missing, no_cust], "flag_id",
                           {"filing_id": c("filing_id"), "message": F.lit(K.MSG_SAR)},
                           {"filing_id": c("filing_id"), "status": F.lit("DRAFT"), "flag_id": c("flag_id"),
                            "message": F.lit(K.MSG_SAR)})
    return ActionResult(new_filings, state, audit, responses)


def flag_accounts(accounts: DataFrame, cases: DataFrame, audit_log: DataFrame, requests: DataFrame,
                  actor: Actor, as_of: str) -> ActionResult:
    """O-B2: requests (request_id, account_id, reason, linked_flag_id) -> FROZEN accounts + new OPEN cases."""
    admitted, denied = role_gate(requests, actor, CASE_ROLES, K.ERR_CASE_ROLE)
    winners, dups = _dedupe(admitted, "account_id")
    a = accounts.select("account_id", c("customer_id").alias("_lg_cust"), c("status").alias("before_status"))
    j = winners.join(a, "account_id", "left")
    missing = j.filter(c("_lg_cust").isNull() & c("before_status").isNull()).withColumn(
        "error", F.lit(K.ERR_ACCOUNT))
    ok = assign_sequential_ids(j.filter(c("before_status").isNotNull()), "request_id",
                               next_id(cases, "case_id"), "case_id")
    now = ts_lit(as_of)
    new_cases = ok.select(
        "case_id", c("_lg_cust").alias("customer_id"), "account_id",
        F.lit(None).cast("bigint").alias("linked_filing_id"),
        c("linked_flag_id").cast("bigint").alias("linked_flag_id"),
        F.lit("FRAUD").alias("case_type"), F.lit("HIGH").alias("severity"), F.lit("OPEN").alias("status"),
        F.lit(actor.user).alias("assigned_to"), F.lit(None).cast("string").alias("escalated_to"),
        F.lit(actor.user).alias("created_by"), now.alias("created_at"), now.alias("updated_at"),
        F.lit(None).cast("date").alias("due_date"), F.lit(False).alias("sla_breach"),
        F.concat(F.lit("Account frozen. Reason: "), F.coalesce(c("reason"), F.lit(""))).alias("resolution_notes"),
        F.lit(None).cast("array<string>").alias("evidence_txn_ids"), F.lit(None).cast("array<string>").alias("tags"))
    upd = ok.select("account_id", F.lit(True).alias("_lg_hit"))
    state = (accounts.join(upd, "account_id", "left")
             .withColumn("status", F.when(c("_lg_hit"), F.lit("FROZEN")).otherwise(c("status"))).drop("_lg_hit"))
    audit = _audit_rows(ok, audit_log, actor, as_of, "FLAG_ACCOUNT", "ACCOUNT", c("account_id"),
                        F.to_json(F.struct(c("before_status").alias("status"))),
                        F.to_json(F.struct(F.lit("FROZEN").alias("status"), c("reason"))),
                        F.concat(F.lit("Account "), c("account_id").cast("string"), F.lit(" frozen. Case "),
                                 c("case_id").cast("string")))
    responses = _responses(ok, [denied, dups, missing], "account_id",
                           {"case_id": c("case_id"), "new_status": F.lit("FROZEN"), "message": F.lit(K.MSG_FREEZE)},
                           {"account_id": c("account_id"), "new_status": F.lit("FROZEN"), "case_id": c("case_id"),
                            "message": F.lit(K.MSG_FREEZE)})
    return ActionResult(new_cases, state, audit, responses)


def escalate_cases(cases: DataFrame, audit_log: DataFrame, requests: DataFrame, actor: Actor,
                   as_of: str) -> ActionResult:
    """O-B3: requests (request_id, case_id, escalate_to, notes) -> ESCALATED cases with appended notes."""
    admitted, denied = role_gate(requests, actor, CASE_ROLES, K.ERR_CASE_ROLE)
    winners, dups = _dedupe(admitted, "case_id")
    k = cases.select("case_id", c("status").alias("before_status"), c("assigned_to").alias("before_assigned"))
    j = winners.join(k, "case_id", "left")
    bad = j.filter(c("before_status").isNull() | c("before_status").isin("RESOLVED", "CLOSED")).withColumn(
        "error", F.lit(K.ERR_CASE))
    ok = cut_lineage(j.filter(c("before_status").isNotNull() & ~c("before_status").isin("RESOLVED", "CLOSED")))
    sfx = F.when(c("notes").isNotNull(), F.concat(F.lit(": "), c("notes"))).otherwise(F.lit(""))
    upd = ok.select("case_id", c("escalate_to").alias("_lg_to"),
                    F.concat(F.lit(" | Escalated by "), F.lit(actor.user), F.lit(" to "), c("escalate_to"), sfx)
                    .alias("_lg_note"), F.lit(True).alias("_lg_hit"))
    state = (cases.join(upd, "case_id", "left")
             .withColumn("status", F.when(c("_lg_hit"), F.lit("ESCALATED")).otherwise(c("status")))
             .withColumn("escalated_to", F.when(c("_lg_hit"), c("_lg_to")).otherwise(c("escalated_to")))
             .withColumn("updated_at", F.when(c("_lg_hit"), ts_lit(as_of)).otherwise(c("updated_at")))
             .withColumn("resolution_notes", F.when(c("_lg_hit"), F.concat(
                 F.coalesce(c("resolution_notes"), F.lit("")), c("_lg_note"))).otherwise(c("resolution_notes")))
             .drop("_lg_hit", "_lg_to", "_lg_note"))
    audit = _audit_rows(ok, audit_log, actor, as_of, "ESCALATE_CASE", "CASE", c("case_id"),
                        F.to_json(F.struct(F.coalesce(c("before_status"), F.lit("")).alias("status"),
                                           F.coalesce(c("before_assigned"), F.lit("")).alias("assigned_to"))),
                        F.to_json(F.struct(F.lit("ESCALATED").alias("status"), c("escalate_to").alias("escalated_to"))),
                        F.concat(F.lit("Case "), c("case_id").cast("string"), F.lit(" escalated to "),
                                 c("escalate_to")))
    responses = _responses(ok, [denied, dups, bad], "case_id",
                           {"new_status": F.lit("ESCALATED"), "message": F.lit(K.MSG_ESCALATE)},
                           {"case_id": c("case_id"), "new_status": F.lit("ESCALATED"), "escalated_to": c("escalate_to"),
                            "message": F.lit(K.MSG_ESCALATE)})
    return ActionResult(None, state, audit, responses)


def audit_append(audit_log: DataFrame, *new_audit: DataFrame) -> DataFrame:
    """O-B4: the log after appending (never updates or deletes existing rows)."""
    out = audit_log
    for a in new_audit:
        out = out.unionByName(a.select(*audit_log.columns))
    return out


def _replayed(audit_log: DataFrame) -> DataFrame:
    event = F.struct("event_ts", "log_id", "action_type", "after_state")
    return audit_log.groupBy("object_type", "object_id").agg(
        F.max(event).alias("last"), F.count(F.lit(1)).alias("events"), F.max("log_id").alias("seen"))


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("object_type", "object_id").agg(
        F.max("last").alias("last"), F.sum("events").alias("events"), F.max("seen").alias("seen"))


def _current(state: DataFrame) -> DataFrame:
    return state.select("object_type", "object_id", c("last.action_type").alias("last_action"),
                        c("last.log_id").alias("last_log_id"), c("last.after_state").alias("after_state"),
                        F.get_json_object(c("last.after_state"), "$.status").alias("current_status"), "events")


def replay_state(audit_log: DataFrame) -> DataFrame:
    """O-B6: current state per audited object = the after_state of its latest event
    (by event_ts, log_id as tiebreak); the maximum aggregates partially, so it is skew-safe."""
    return _current(_replayed(audit_log))


class ReplaySnapshot:
    """O-B6 without reading the whole log again: the last event, event count and highest log id of every object, stored,
    and merged with the log's tail.  The log only grows, with rising ids, so the tail is what lies above the highest id
    seen (``high_water``), a filter that reaches the scan."""

    def __init__(self, state: DataFrame, high_water: int):
        self.state, self.high_water = state, high_water

    @classmethod
    def of(cls, audit_log: DataFrame) -> ReplaySnapshot:
        return cls._stored(_replayed(audit_log), 0)

    @classmethod
    def _stored(cls, state: DataFrame, floor: int) -> ReplaySnapshot:
        state = cut_lineage(state)
        seen = state.agg(F.max("seen")).first()[0]     # one number
        return cls(state, floor if seen is None else max(floor, seen))

    def tail(self, audit_log: DataFrame) -> DataFrame:
        return audit_log.filter(c("log_id") > self.high_water)

    def advanced(self, audit_log: DataFrame) -> ReplaySnapshot:
        """The snapshot after the log's new rows."""
        return self._stored(_merged(self.state.unionByName(_replayed(self.tail(audit_log)))), self.high_water)

    def current(self, audit_log: DataFrame | None = None) -> DataFrame:
        """The state of every object, with the log's new rows if a log is given."""
        if audit_log is None:
            return _current(self.state)
        return _current(_merged(self.state.unionByName(_replayed(self.tail(audit_log)))))
