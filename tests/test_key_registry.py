"""Registered ids: one number a key for good, none shared, text transaction ids in the flags."""

from pyspark.sql import functions as F

from ledgerguard.operators import fraud
from ledgerguard.operators.key_registry import KeyRegistry


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def test_every_key_keeps_its_number(spark, tmp_path):
    r = KeyRegistry(spark, str(tmp_path / "ids"), 100)
    one = {x.key: x.id for x in r.register(keys(spark, [f"a{i}" for i in range(500)] * 2 + [None])).collect()}
    assert sorted(one.values()) == list(range(101, 601)) and None not in one
    two = {x.key: x.id for x in r.register(keys(spark, [f"a{i}" for i in range(300, 900)])).collect()}
    assert {k: two[k] for k in one} == one and sorted(two.values()) == list(range(101, 1001))
    assert r.register(keys(spark, ["a1", "a2"])).count() == 900 and r.register(keys(spark, [])).count() == 900


def test_flags_of_text_ids(spark, tmp_path):
    """Plain numbers keep their id in the fraud range, other ids get registered ones outside every domain's range."""
    odd = ["007", "-5", "1e3", "2000000000000000", "f47ac10b-58cc", "", "zz"]
    rows = [(x, 1, "VELOCITY", True, 70.0) for x in [*odd, "7", "8"]] + [("quiet", 1, None, False, 10.0)]
    t = spark.createDataFrame(rows, "txn_id string, account_id long, fraud_pattern string, is_flagged boolean, flag_score double")
    t = t.select("*", *[F.lit(None).cast("string").alias(x) for x in ("review_status", "channel", "country_code", "counterparty_account")],
                 F.lit(1.0).alias("amount"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz").alias("txn_ts"))
    accounts = spark.createDataFrame([(1, 10)], "account_id long, customer_id long")
    registry = fraud.flag_id_registry(spark, str(tmp_path / "ids"))
    ids = fraud.register_flag_ids(t, registry)
    got = {r.txn_id: r.flag_id for r in fraud.build_fraud_flags(t, accounts, ids=ids).collect()}
    assert got["7"] == fraud.FRAUD_ID_BASE + 7 and got["8"] == fraud.FRAUD_ID_BASE + 8 and "quiet" not in got
    assert sorted(got[x] for x in odd) == [fraud.TEXT_ID_BASE + i for i in range(1, len(odd) + 1)]
    again = fraud.build_fraud_flags(t, accounts, ids=fraud.register_flag_ids(t, registry))
    assert {r.txn_id: r.flag_id for r in again.collect()} == got
