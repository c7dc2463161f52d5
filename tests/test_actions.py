"""Set-based actions: gate, de-duplication, validation, ids, audit trail."""

import datetime as dt

import pytest

from ledgerguard.functions import constants as K
from ledgerguard.operators import actions as A
from ledgerguard.operators.governance import Actor
from ledgerguard.sources.schemas import BANK_SCHEMAS, RISK_FLAGS_SCHEMA, conform

AS_OF = "2024-01-31 00:00:00"
OFFICER = Actor("co" + K.BANK_DOMAIN, K.ROLE_COMPLIANCE)


@pytest.fixture()
def tables(spark):
    flags = conform(spark.createDataFrame(
        [(1, "FRAUD", "VELOCITY", "HIGH", "PENDING", 10, 100, 70.0),
         (2, "FRAUD", "STRUCTURING", "HIGH", "ACTIONED", 10, 100, 66.0),
         (3, "LIQUIDITY", "LCR_BREACH", "CRITICAL", "OPEN", None, None, 95.0),
         (4, "CREDIT", "NPA", "CRITICAL", "OPEN", 11, None, 92.0)],
        "flag_id long, flag_domain string, flag_type string, severity string, flag_status string, "
        "customer_id long, account_id long, flag_score double"), RISK_FLAGS_SCHEMA)
    filings = conform(spark.createDataFrame([(500,)], "filing_id long"), BANK_SCHEMAS["regulatory_filings"])
    audit = conform(spark.createDataFrame([(7,)], "log_id long"), BANK_SCHEMAS["audit_log"])
    accounts = conform(spark.createDataFrame([(100, 10, "ACTIVE"), (101, 11, "DORMANT")],
                                             "account_id long, customer_id long, status string"),
                       BANK_SCHEMAS["accounts"])
    cases = conform(spark.createDataFrame(
        [(40, 10, 100, "OPEN", "n1"), (41, 11, 101, "RESOLVED", None), (42, 11, 101, "UNDER_REVIEW", None)],
        "case_id long, customer_id long, account_id long, status string, resolution_notes string"),
        BANK_SCHEMAS["case_escalations"])
    return flags, filings, audit, accounts, cases


def test_sar_batch(spark, tables):
    flags, filings, audit, _, _ = tables
    req = spark.createDataFrame([(1, 1, None), (2, 1, "again"), (3, 2, None), (4, 3, None), (5, 99, None),
                                 (6, 4, "board")], "request_id long, flag_id long, notes string")
    res = A.file_sar_drafts(flags, filings, audit, req, OFFICER, AS_OF)
    r = {x.request_id: x for x in res.responses.collect()}
    assert r[1].status == "ok" and r[1].filing_id == 501
    assert r[2].error == "Duplicate request in batch"
    assert r[3].error == "Flag not found or already actioned" and r[5].error == "Flag not found or already actioned"
    assert r[4].error == "no_customer"
    assert r[6].status == "ok" and r[6].filing_id == 502
    new = {x.filing_id: x for x in res.new_rows.collect()}
    assert new[501].reference_case_id == "SAR-FLAG-1" and new[501].narrative.endswith("Regulatory basis: ")
    assert new[502].narrative.endswith(". Notes: board") and new[502].account_id is None
    st = {x.flag_id: (x.flag_status, x.action_taken) for x in res.state.collect()}
    assert st[1] == ("ACTIONED", "SAR_FILED") and st[4] == ("ACTIONED", "SAR_FILED") and st[3] == ("OPEN", None)
    au = sorted((x.log_id, x.object_id) for x in res.audit.collect())
    assert au == [(8, "501"), (9, "502")]


def test_wrong_role_rejects_everything(spark, tables):
    flags, filings, audit, _, _ = tables
    req = spark.createDataFrame([(1, 1, None)], "request_id long, flag_id long, notes string")
    res = A.file_sar_drafts(flags, filings, audit, req, Actor("x", K.ROLE_ANALYST), AS_OF)
    assert [x.error for x in res.responses.collect()] == ["COMPLIANCE_OFFICER or higher required."]
    assert res.new_rows.count() == 0 and res.audit.count() == 0


def test_freeze_then_escalate(spark, tables):
    _, _, audit, accounts, cases = tables
    req = spark.createDataFrame([(1, 100, "fraud", 1), (2, 555, "nope", None), (3, 100, "dup", None)],
                                "request_id long, account_id long, reason string, linked_flag_id long")
    frz = A.flag_accounts(accounts, cases, audit, req, OFFICER, AS_OF)
    r = {x.request_id: x for x in frz.responses.collect()}
    assert r[1].case_id == 43 and r[2].error == "Account not found" and r[3].error == "Duplicate request in batch"
    assert {x.account_id: x.status for x in frz.state.collect()}[100] == "FROZEN"
    case = frz.new_rows.collect()[0]
    assert case.linked_flag_id == 1 and case.linked_filing_id is None and case.status == "OPEN"
    esc_req = spark.createDataFrame([(1, 40, "chief", "look"), (2, 41, "chief", None), (3, 42, "chief", None)],
                                    "request_id long, case_id long, escalate_to string, notes string")
    esc = A.escalate_cases(cases, audit, esc_req, OFFICER, AS_OF)
    r = {x.request_id: x for x in esc.responses.collect()}
    assert r[1].status == "ok" and r[2].error == "Case not found or already resolved/closed" and r[3].status == "ok"
    st = {x.case_id: x for x in esc.state.collect()}
    assert st[40].resolution_notes == "n1 | Escalated by co@bank.example to chief: look"
    assert st[42].resolution_notes == " | Escalated by co@bank.example to chief"


def test_replay_takes_latest_event(spark):
    t = dt.datetime(2024, 1, 1)
    audit = conform(spark.createDataFrame(
        [(1, t, "ACCOUNT", "5", "FLAG_ACCOUNT", '{"status":"FROZEN"}'),
         (2, t + dt.timedelta(hours=1), "ACCOUNT", "5", "FLAG_ACCOUNT", '{"status":"ACTIVE"}'),
         (9, t, "ACCOUNT", "6", "FLAG_ACCOUNT", '{"status":"FROZEN"}')],
        "log_id long, event_ts timestamp_ntz, object_type string, object_id string, action_type string, "
        "after_state string"), BANK_SCHEMAS["audit_log"])
    st = {r.object_id: r.current_status for r in A.replay_state(audit).collect()}
    assert st == {"5": "ACTIVE", "6": "FROZEN"}


def test_responses_are_the_callers_json(spark, tables):
    """O-B5: what a caller of the single action gets, for accepted and for refused requests."""
    import json
    flags, filings, audit, accounts, cases = tables
    req = spark.createDataFrame([(1, 1, None), (2, 99, None)], "request_id long, flag_id long, notes string")
    sar = {r.request_id: json.loads(r.response) for r in A.file_sar_drafts(flags, filings, audit, req, OFFICER, AS_OF).responses.collect()}
    assert sar == {1: {"filing_id": 501, "status": "DRAFT", "flag_id": 1, "message": K.MSG_SAR}, 2: {"error": K.ERR_FLAG}}
    req = spark.createDataFrame([(1, 100, "fraud", 1), (2, 555, "nope", None)],
                                "request_id long, account_id long, reason string, linked_flag_id long")
    frz = {r.request_id: json.loads(r.response) for r in A.flag_accounts(accounts, cases, audit, req, OFFICER, AS_OF).responses.collect()}
    assert frz == {1: {"account_id": 100, "new_status": "FROZEN", "case_id": 43, "message": K.MSG_FREEZE}, 2: {"error": K.ERR_ACCOUNT}}
    req = spark.createDataFrame([(1, 40, "chief", "look"), (2, 41, "chief", None)],
                                "request_id long, case_id long, escalate_to string, notes string")
    esc = {r.request_id: json.loads(r.response) for r in A.escalate_cases(cases, audit, req, OFFICER, AS_OF).responses.collect()}
    assert esc == {1: {"case_id": 40, "new_status": "ESCALATED", "escalated_to": "chief", "message": K.MSG_ESCALATE}, 2: {"error": K.ERR_CASE}}


def test_replay_from_a_snapshot_reads_the_tail(spark, tmp_path):
    """A snapshot advanced by three appended batches equals the replay of the whole log; only new rows are read."""
    import contextlib
    import io
    import random
    rng = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "log")
    schema = ("log_id long, event_ts timestamp_ntz, object_type string, object_id string, action_type string, after_state string")

    def append(ids):
        rows = [(i, t + dt.timedelta(minutes=rng.randrange(500)), rng.choice(["ACCOUNT", "CASE"]), str(rng.randrange(20)),
                 rng.choice("XYZ"), '{"status":"S%d"}' % rng.randrange(9) if rng.random() < .8 else None) for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)
    append(range(1, 200))
    log = lambda: spark.read.schema(schema).parquet(path)
    snapshot = A.ReplaySnapshot.of(log())
    for batch in (range(200, 260), range(260, 261), range(300, 400)):
        append(batch)
        assert rows(snapshot.current(log())) == rows(A.replay_state(log()))
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            snapshot.current(log()).explain("formatted")
        assert f"GreaterThan(log_id,{snapshot.high_water})" in buf.getvalue()
        snapshot = snapshot.advanced(log())
        assert snapshot.high_water == max(batch) and rows(snapshot.current()) == rows(A.replay_state(log()))
    none = A.ReplaySnapshot.of(log().limit(0))
    assert none.high_water == 0 and rows(none.current(log())) == rows(A.replay_state(log()))


def test_backfill_touches_only_its_partitions(spark, tmp_path):
    from pyspark.sql import functions as F
    from ledgerguard.sources import sinks as SK
    path = str(tmp_path / "t")
    df = spark.range(0, 1000, 1, 16).select("id", F.lit(None).cast("long").alias("x"), (F.col("id") % 5).alias("d"))
    SK.append_table(df, path, ["d"])

    def files():
        got = spark.read.parquet(path).select("d", "_metadata.file_path").distinct().collect()
        return {d: sorted(r.file_path for r in got if r.d == d) for d in range(5)}
    before = files()
    assert all(len(f) == 1 for f in before.values())        # 16 tasks, one file a partition
    SK.backfill_table(df.filter("d in (1, 3)").withColumn("x", F.col("id") * 2), path, ["d"])
    after = files()
    assert all((after[d] == before[d]) == (d not in (1, 3)) for d in range(5))
    back = spark.read.parquet(path)
    assert back.count() == 1000 and back.filter("x = id * 2").count() == 400 == back.filter("d in (1, 3)").count()
