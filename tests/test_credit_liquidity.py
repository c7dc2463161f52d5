"""Credit and liquidity boundaries."""

from decimal import Decimal

from ledgerguard.operators.credit import build_credit_flags, derive_credit
from ledgerguard.operators.liquidity import build_liquidity_flags, derive_liquidity
from ledgerguard.sources.schemas import BANK_SCHEMAS, conform


def exposures(spark, rows):
    """rows: (exposure_id, account_id, pd, utilisation)"""
    data = [(e, 1, a, Decimal(str(pd)), Decimal("0.5000"), Decimal("1000.00"), Decimal("100.00"),
             None if u is None else Decimal(str(u)), Decimal("1000.00")) for e, a, pd, u in rows]
    return conform(spark.createDataFrame(
        data, "exposure_id long, customer_id long, account_id long, pd_score decimal(6,4), lgd decimal(6,4), "
              "ead decimal(18,2), risk_weight_pct decimal(6,2), utilisation_pct decimal(5,2), "
              "outstanding decimal(18,2)"), BANK_SCHEMAS["credit_exposures"])


def test_pd_and_utilisation_boundaries(spark):
    rows = [(1, 10, 0.15, 10), (2, 10, 0.1501, 10), (3, 10, 0.20, 10), (4, 10, 0.2001, 10), (5, 10, 0.35, 10),
            (6, 10, 0.3501, 10), (7, 10, 0.05, 90), (8, 10, 0.05, 90.01), (9, 10, 0.05, None),
            (10, None, 0.40, None), (11, 20, 0.05, None)]
    acc = spark.createDataFrame([(10, False), (20, True)], "account_id long, npa_flag boolean")
    e = derive_credit(exposures(spark, rows))
    f = {r.flag_id - 2 * 10**15: r for r in build_credit_flags(e, acc).collect()}
    assert 1 not in f                                   # PD 0.15 is not above 0.15
    assert f[2].flag_type == "HIGH_PD" and f[2].severity == "MEDIUM"
    assert f[3].severity == "MEDIUM" and f[4].severity == "HIGH"
    assert f[5].flag_type == "HIGH_PD" and f[6].flag_type == "HIGH_PD_SEVERE" and f[6].severity == "CRITICAL"
    assert 7 not in f and f[8].flag_type == "HIGH_UTILISATION" and 9 not in f
    assert f[10].account_id is None and f[10].flag_type == "HIGH_PD_SEVERE"   # NULL account kept
    assert f[11].flag_type == "NPA" and f[11].severity == "CRITICAL" and f[11].flag_score == Decimal("92.00")
    assert f[2].flag_score == Decimal("58.80")          # 58 + 0.08 * 10
    el = {r.exposure_id: r.expected_loss for r in e.collect()}
    assert el[2] == Decimal("75.05")                    # 0.1501 * 0.5 * 1000


def positions(spark, rows):
    """rows: (position_id, numerator (as L1), denominator, nsfr)"""
    data = [(p, Decimal(str(num)), Decimal("0.00"), Decimal(str(den)), Decimal(str(nsfr)),
             Decimal("1.00"), Decimal("1.00")) for p, num, den, nsfr in rows]
    df = spark.createDataFrame(
        data, "position_id long, hqla_level1 decimal(18,2), hqla_level2 decimal(18,2), "
              "lcr_denominator decimal(18,2), nsfr_ratio decimal(18,4), inflow decimal(18,2), outflow decimal(18,2)"
    ).selectExpr("*", "CAST('2024-01-05' AS DATE) AS position_date", "'0_7D' AS tenor_bucket",
                 "'BASE' AS stress_scenario")
    return conform(df, BANK_SCHEMAS["liquidity_positions"])


def test_lcr_boundaries(spark):
    rows = [(1, 79.99, 100, 1.2), (2, 80, 100, 1.2), (3, 89.99, 100, 1.2), (4, 90, 100, 1.2),
            (5, 99996, 100000, 1.2), (6, 100, 100, 1.2), (7, 100, 0, 1.2), (8, 100, 100, 0.99)]
    p = {r.position_id: r for r in derive_liquidity(positions(spark, rows)).collect()}
    assert p[5].lcr_ratio == Decimal("1.0000") and p[5].lcr_breach      # rounds to 1 yet breaches
    assert not p[6].lcr_breach and p[7].lcr_ratio is None and not p[7].lcr_breach
    f = {r.flag_id - 3 * 10**15: r for r in build_liquidity_flags(derive_liquidity(positions(spark, rows))).collect()}
    assert f[1].severity == "CRITICAL" and f[1].flag_score == 95
    assert f[2].severity == "HIGH" and f[3].severity == "HIGH"
    assert f[4].severity == "MEDIUM" and f[4].flag_score == 67
    assert f[5].flag_type == "LCR_BREACH" and f[5].flag_score == 58
    assert 6 not in f and 7 not in f
    assert f[8].flag_type == "NSFR_BREACH" and f[8].threshold_field == "nsfr_ratio"


def test_flags_are_derived_from_the_stored_tables(spark):
    """A job that reads a table and its flags derives the table once: the flags read the snapshot."""
    from conftest import SF001
    from ledgerguard.plans.context import RiskContext
    ctx = RiskContext(spark, SF001)
    assert ctx.credit_exposures.count() > 0
    assert not [f for f in ctx.derived_credit_flags.inputFiles() if "lineitem" in f]


def test_metrics_of_flags_and_exposures_derive_the_exposures_once(spark):
    """The flags come first in the request; the exposures are stored before the flags are derived from them."""
    from conftest import SF001
    from ledgerguard.plans.context import RiskContext
    from ledgerguard.plans.semantic_queries import metric_query_two_facts_filtered
    ctx = RiskContext(spark, SF001)
    assert metric_query_two_facts_filtered(ctx).columns == ["segment", "open_flag_count", "total_rwa"]
    assert not [f for f in ctx.derived_credit_flags.inputFiles() if "lineitem" in f]
