"""Rule catalog and small column functions shared by the flag builders.

The catalog is a constant-size literal map (no join, nothing to broadcast):
``rationale(flag_type)`` is an ``element_at(map, flag_type)`` lookup inside the
whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K

# --- fixed values: rule catalog (flag_type -> field, limit, citation) --------
RULE_CATALOG = [
    ("VELOCITY", "flag_score", 65.0,
     "Five or more transactions on one account inside the rule's window; rapid movement of funds "
     "(FinCEN SAR item 35(a); velocity rule V-001)"),
    ("STRUCTURING", "flag_score", 65.0,
     "Amount between 9,800 and 9,999 just under the 10,000 currency-reporting line "
     "(31 CFR 1010.314; PMLA Rule 3(B))"),
    ("CROSS_BORDER", "flag_score", 65.0,
     "Payment involving a FATF high-risk or monitored jurisdiction; enhanced due diligence "
     "(FATF Recommendation 19; RBI KYC Direction 2016 s.38)"),
    ("ROUND_NUMBER", "flag_score", 65.0,
     "Round amount above 10,000; trade-based laundering indicator "
     "(FATF TBML typologies 2020; rule R-007)"),
    ("NPA", "npa_flag", 0.0,
     "Account is non-performing, 90 days past due "
     "(RBI IRAC master circular 2023; provisioning 15% / 25-100% / 100%)"),
    ("HIGH_PD_SEVERE", "pd_score", 0.15,
     "Probability of default above 0.35; board notice under ICAAP, IFRS 9 stage 3 lifetime ECL"),
    ("HIGH_PD", "pd_score", 0.15,
     "Probability of default above 0.15; ICAAP watch-list, quarterly review (credit policy 4.2)"),
    ("HIGH_UTILISATION", "utilisation_pct", 90.0,
     "Facility utilisation above 90%; limit review required (credit policy 6.1)"),
    ("WATCH_LIST", None, None,
     "Credit watch-list: internal monitoring threshold exceeded"),
    ("LCR_BREACH", "lcr_ratio", 1.0,
     "Liquidity coverage ratio below 100% (Basel III / CRR Art. 412); notify supervisor "
     "within 2 business days; intraday trigger at 95%"),
    ("DUAL_BREACH", "lcr_ratio", 1.0,
     "Liquidity coverage ratio below 100% (Basel III / CRR Art. 412); notify supervisor "
     "within 2 business days; intraday trigger at 95%"),
    ("NSFR_BREACH", "nsfr_ratio", 1.0,
     "Net stable funding ratio below 100% (Basel III / CRR Art. 428b); escalate to ALM committee"),
]

# --- fixed values: dashboard tips per flag type ------------------------------
SHORT_TIPS = {
    "VELOCITY": "Burst of payments on one account",
    "STRUCTURING": "Amounts kept just under the reporting line",
    "CROSS_BORDER": "High-risk jurisdiction involved",
    "ROUND_NUMBER": "Large round amount",
    "NPA": "Non-performing account",
    "HIGH_PD_SEVERE": "Default probability above 35%",
    "HIGH_PD": "Default probability above 15%",
    "LCR_BREACH": "Liquidity coverage below 100%",
}


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(pairs) -> Column:
    """A literal map built as one SQL expression (one JVM call instead of one per literal)."""
    return F.expr("map(" + ", ".join(f"{_sql_str(k)}, {_sql_str(v)}" for k, v in pairs) + ")")


def rationale(flag_type: Column) -> Column:
    """O-D26: citation text of a flag type."""
    return F.element_at(_map([(t, c) for t, _, _, c in RULE_CATALOG]), flag_type)


def short_tip(flag_type: Column) -> Column:
    return F.element_at(_map(SHORT_TIPS.items()), flag_type)


def rule_catalog_df(spark):
    """The catalog as a (constant-size) DataFrame, for reports and tests."""
    return spark.createDataFrame(
        [(t, f, float(lim) if lim is not None else None, c) for t, f, lim, c in RULE_CATALOG],
        "flag_type string, threshold_field string, threshold_limit double, citation string")


def fraud_severity(pattern: Column) -> Column:
    """O-D8."""
    out = None
    for p, sev in K.FRAUD_SEVERITY.items():
        out = (F.when(pattern == p, sev) if out is None else out.when(pattern == p, sev))
    return out


def score_band(score: Column) -> Column:
    """O-D29: low <= 40 < medium <= 65 < high."""
    return F.when(score.isNull(), None).when(score <= 40, "low").when(score <= 65, "medium").otherwise("high")


def severity_rank(severity: Column) -> Column:
    """O-T3: custom severity order CRITICAL < HIGH < MEDIUM < other."""
    return (F.when(severity == "CRITICAL", 1).when(severity == "HIGH", 2)
            .when(severity == "MEDIUM", 3).otherwise(4))


def strict_open(status: Column) -> Column:
    """'Open' meaning 1: status is literally OPEN."""
    return status == "OPEN"


def unactioned(status: Column) -> Column:
    """'Open' meaning 2: neither ACTIONED nor DISMISSED (NULL -> not selected)."""
    return ~status.isin("ACTIONED", "DISMISSED")
