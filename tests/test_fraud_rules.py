"""Rule boundaries for the fraud detectors (hand-made rows)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerguard.operators.fraud import (build_fraud_flags, classify_fraud, detect_cross_border, detect_round_number,
                                         detect_structuring, detect_velocity)
from ledgerguard.sources.schemas import BANK_SCHEMAS

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def txns(spark, rows):
    """rows: (txn_id, account_id, seconds after T0, amount, country)"""
    data = [(str(i), a, T0 + dt.timedelta(seconds=s), Decimal(str(amt)), "USD", "DEBIT", "WIRE", None, None, c,
             "TRANSFER", None, None) for i, a, s, amt, c in rows]
    return spark.createDataFrame(data, BANK_SCHEMAS["transactions"])


def test_velocity_counts_and_boundary(spark):
    # account 1: 5 txns, the 5th exactly 3600 s after the first -> inside the window
    # account 2: 5 txns, the 5th 3601 s after the first -> the first has left the window
    # account 3: interleaved with ties on the same timestamp
    rows = [(1, 1, 0, 10, "USA"), (2, 1, 600, 10, "USA"), (3, 1, 1200, 10, "USA"), (4, 1, 1800, 10, "USA"),
            (5, 1, 3600, 10, "USA"),
            (6, 2, 0, 10, "USA"), (7, 2, 600, 10, "USA"), (8, 2, 1200, 10, "USA"), (9, 2, 1800, 10, "USA"),
            (10, 2, 3601, 10, "USA"),
            (11, 3, 100, 10, "USA"), (12, 3, 100, 10, "USA"), (13, 3, 100, 10, "USA"), (14, 3, 200, 10, "USA"),
            (15, 3, 300, 10, "USA"), (16, 3, 300, 10, "USA")]
    v = {r.txn_id: (r.velocity_count, r.is_velocity) for r in detect_velocity(txns(spark, rows)).collect()}
    assert v["5"] == (5, True)
    assert v["4"] == (4, False)
    assert v["10"] == (4, False)
    assert v["11"] == (3, False) and v["13"] == (3, False)  # peers count each other
    assert v["15"] == (6, True) and v["16"] == (6, True)


def test_velocity_across_bucket_edge(spark):
    # six txns 20 minutes apart straddle an hour boundary: counts must not reset at the edge
    rows = [(i, 9, 3000 + 600 * i, 10, "USA") for i in range(6)]
    v = {r.txn_id: r.velocity_count for r in detect_velocity(txns(spark, rows)).collect()}
    assert [v[str(i)] for i in range(6)] == [1, 2, 3, 4, 5, 6]


def test_velocity_burst_marks_early_members(spark):
    rows = [(i, 1, 600 * i, 10, "USA") for i in range(5)]
    out = {r.txn_id: r for r in detect_velocity(txns(spark, rows), mark_burst=True).collect()}
    assert all(out[str(i)].is_velocity_burst for i in range(5))
    assert not out["0"].is_velocity and out["4"].is_velocity


def test_structuring_band(spark):
    amounts = [9799.99, 9800, 9999, 9999.99, 10000]
    df = detect_structuring(txns(spark, [(i, 1, i, a, "USA") for i, a in enumerate(amounts)]))
    hit = {float(r.amount): r.is_structuring for r in df.collect()}
    assert hit == {9799.99: False, 9800.0: True, 9999.0: True, 9999.99: False, 10000.0: False}


def test_round_number(spark):
    amounts = [10000, 11000, 10500, 11000.01]
    df = detect_round_number(txns(spark, [(i, 1, i, a, "USA") for i, a in enumerate(amounts)]))
    hit = {float(r.amount): r.is_round_number for r in df.collect()}
    assert hit == {10000.0: False, 11000.0: True, 10500.0: False, 11000.01: False}


def test_cross_border_list_and_null(spark):
    df = detect_cross_border(txns(spark, [(1, 1, 0, 5, "IRN"), (2, 1, 1, 5, "USA"), (3, 1, 2, 5, None)]))
    assert {r.txn_id: r.high_risk_country for r in df.collect()} == {"1": True, "2": False, "3": False}


def test_classify_precedence_and_scores(spark):
    rows = [(1, 1, 0, 9900, "IRN"),       # structuring + cross-border -> STRUCTURING
            (2, 2, 0, 12000, "SYR"),      # cross-border + round number -> CROSS_BORDER
            (3, 3, 0, 12000, "USA"),      # round number
            (4, 4, 0, 50, "USA")]         # nothing
    out = {r.txn_id: r for r in classify_fraud(txns(spark, rows)).collect()}
    assert out["1"].fraud_pattern == "STRUCTURING" and out["1"].patterns == ["STRUCTURING", "CROSS_BORDER"]
    assert out["2"].fraud_pattern == "CROSS_BORDER"
    assert out["3"].fraud_pattern == "ROUND_NUMBER"
    assert out["4"].fraud_pattern is None and not out["4"].is_flagged and out["4"].review_status is None
    assert 60 <= out["1"].flag_score <= 85 and 70 <= out["2"].flag_score <= 95 and 55 <= out["3"].flag_score <= 75
    assert 5 <= out["4"].flag_score <= 40
    assert out["1"].review_status in ("PENDING", "CLEARED", "CONFIRMED_FRAUD")


def test_fraud_flags_payload_drops_nulls(spark):
    t = classify_fraud(txns(spark, [(1, 1, 0, 9900, "USA")]))
    acc = spark.createDataFrame([(1, 77)], "account_id long, customer_id long")
    f = build_fraud_flags(t, acc).collect()[0]
    assert f.customer_id == 77 and f.severity == "HIGH" and f.flag_type == "STRUCTURING"
    assert '"counterparty_account"' not in f.evidence_payload  # NULL key left out
    assert f.flag_id == 10**15 + 1


def test_one_hour_rule_yields_nothing_on_fixture(spark):
    from ledgerguard.sources.adapters import bank_table
    t = detect_velocity(bank_table(spark, "/root/testdata/sf0.01", "transactions"))
    assert t.filter(F.col("is_velocity")).count() == 0
