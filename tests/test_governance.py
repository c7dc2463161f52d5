"""Masking, row filter, secure view and role closure."""

from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.operators import governance as G

ROLES = K.ALL_ROLES + ["UNKNOWN_ROLE"]


def test_masks_per_role(spark):
    df = spark.createDataFrame([("ID1234567", "Ada Lovelace", "ACC0000000042"), ("12", "Plato", "A1"),
                                (None, None, None)], "nid string, name string, acct string")
    for role in ROLES:
        out = df.select(G.mask_national_id(F.col("nid"), role).alias("n"), G.mask_full_name(F.col("name"), role)
                        .alias("f"), G.mask_account_number(F.col("acct"), role).alias("a")).collect()
        if role in G.FULL_PII_ROLES:
            assert out[0].n == "ID1234567" and out[0].f == "Ada Lovelace"
        else:
            assert out[0].n == "XXX-XX-4567" and out[0].f == "Ada ***"
            assert out[1].n == "XXX-XX-12" and out[1].f == "Plato ***"     # short value, no space
        if role in G.FULL_ACCOUNT_ROLES:
            assert out[0].a == "ACC0000000042"
        elif role in G.PARTIAL_ACCOUNT_ROLES:
            assert out[0].a == "XXXX-0042"
        else:
            assert out[0].a == "XXXX-XXXX-0042"
        assert out[2].n is None or role in G.FULL_PII_ROLES


def test_secure_view_masks_before_projection_and_filters_rows(spark):
    filings = spark.createDataFrame([(1, "me@partner.example"), (2, "x" + K.BANK_DOMAIN), (3, "other@else.example")],
                                    "filing_id long, assigned_to string")
    mgr = G.secure_view("regulatory_filings", filings, G.Actor("me@partner.example", K.ROLE_MANAGER))
    assert sorted(r.filing_id for r in mgr.collect()) == [1, 2]
    assert G.secure_view("regulatory_filings", filings, G.Actor("a", K.ROLE_ANALYST)).count() == 0
    assert G.secure_view("regulatory_filings", filings, G.Actor("a", K.ROLE_AUDITOR)).count() == 3
    cust = spark.createDataFrame([(1, "ID7654321", "Bo Li")], "customer_id long, national_id string, full_name string")
    v = G.secure_view("customers", cust, G.Actor("a", K.ROLE_ANALYST)).select("national_id")
    assert v.collect()[0].national_id == "XXX-XX-4321"


def test_role_closure_and_effective_access(spark):
    acc = G.effective_access(spark, G.role_edges_df(spark), G.grants_df(spark))
    ex = {(r.role, r.object) for r in acc.filter(F.col("privilege") == "EXECUTE").collect()}
    assert (K.ROLE_ADMIN, "FILE_SAR") in ex and (K.ROLE_PLATFORM, "ESCALATE_CASE") in ex
    assert (K.ROLE_MANAGER, "FILE_SAR") not in ex and (K.ROLE_COMPLIANCE, "FLAG_ACCOUNT") in ex
    assert not any(r == K.ROLE_ANALYST for r, _ in ex)
