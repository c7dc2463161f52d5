"""Credit risk derivations and flags (O-D10..O-D18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.functions.rules import rationale
from ledgerguard.session import ts_lit
from ledgerguard.sources.schemas import RISK_FLAGS_SCHEMA, conform

CREDIT_ID_BASE = 2_000_000_000_000_000


def expected_loss(pd: Column, lgd: Column, ead: Column) -> Column:
    """O-D10: round(PD * LGD * EAD, 2) in exact decimal arithmetic."""
    return F.round(pd * lgd * ead, 2).cast("decimal(18,2)")


def risk_weighted_assets(ead: Column, weight_pct: Column) -> Column:
    """O-D11: round(EAD * weight / 100, 2), written as * 0.01 to stay decimal."""
    return F.round(ead * weight_pct * F.lit(0.01).cast("decimal(3,2)"), 2).cast("decimal(18,2)")


def utilisation(outstanding: Column, limit: Column) -> Column:
    """O-D13: outstanding / limit * 100 (NULL on a zero or missing limit)."""
    return F.round(F.try_divide(outstanding.cast("double"), limit.cast("double")) * 100, 2).cast("decimal(5,2)")


def derive_credit(exposures: DataFrame, watch_pd: float = K.WATCH_LIST_PD) -> DataFrame:
    """Back-fill expected loss, RWA, utilisation and the watch-list flag (O-D10..D13), one projection."""
    c = F.col
    derived = {
        "expected_loss": expected_loss(c("pd_score"), c("lgd"), c("ead")),
        "rwa": risk_weighted_assets(c("ead"), c("risk_weight_pct")),
        "utilisation_pct": utilisation(c("outstanding"), c("credit_limit")),
        "watch_list_flag": c("pd_score") > F.lit(watch_pd),
    }
    return fill_columns(exposures, derived)


def fill_columns(df: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """O-S7 for several columns at once: existing columns are coalesced, new ones appended."""
    cols = [F.coalesce(F.col(x), derived[x]).alias(x) if x in derived else F.col(x) for x in df.columns]
    cols += [v.alias(k) for k, v in derived.items() if k not in df.columns]
    return df.select(*cols)


def credit_payload() -> Column:
    """O-D27: 15-key evidence object (NULL keys dropped)."""
    c = F.col
    return F.to_json(F.struct(
        c("customer_id"), c("account_id"), c("exposure_id"), c("facility_type"), c("outstanding"),
        c("pd_score"), c("lgd"), c("ead"), c("expected_loss"), c("rwa"), c("sector"), c("internal_rating"),
        c("utilisation_pct"), c("npa_flag"), c("collateral_type")))


def build_credit_flags(exposures: DataFrame, accounts: DataFrame, as_of: str = "2024-01-31 00:00:00",
                       watch_pd: float = K.WATCH_LIST_PD, high_pd: float = K.HIGH_PD,
                       severe_pd: float = K.SEVERE_PD, util_limit: float = K.UTILISATION_LIMIT) -> DataFrame:
    """O-D14..O-D18.  Left join keeps exposures whose account is NULL (never matched)."""
    acc = accounts.select("account_id", "npa_flag")
    j = exposures.join(acc, "account_id", "left")
    c = F.col
    npa = F.coalesce(c("npa_flag"), F.lit(False))
    watch = F.coalesce(c("watch_list_flag"), F.lit(False))
    util_hi = F.coalesce(c("utilisation_pct") > util_limit, F.lit(False))
    pd = c("pd_score")
    j = j.filter(watch | util_hi | npa)
    flag_type = (F.when(npa, "NPA").when(pd > severe_pd, "HIGH_PD_SEVERE").when(watch, "HIGH_PD")
                 .when(util_hi, "HIGH_UTILISATION").otherwise("WATCH_LIST"))
    severity = F.when((pd > severe_pd) | npa, "CRITICAL").when(pd > high_pd, "HIGH").otherwise("MEDIUM")
    field = F.when(watch, "pd_score").when(util_hi, "utilisation_pct").otherwise("npa_flag")
    value = F.when(watch, pd.cast("decimal(14,4)")).when(util_hi, c("utilisation_pct").cast("decimal(14,4)")) \
        .otherwise(F.lit(1).cast("decimal(14,4)"))
    limit = F.when(watch, F.lit(watch_pd)).when(util_hi, F.lit(util_limit)).otherwise(F.lit(0)).cast("decimal(14,4)")
    base = (F.when(npa, 92).when(pd > severe_pd, 88).when(pd > high_pd, 72).when(pd > watch_pd, 58)
            .otherwise(50))
    score = F.round(F.least(F.lit(100).cast("decimal(10,2)"),
                            base.cast("decimal(10,2)") + F.coalesce(c("utilisation_pct"), F.lit(0)) * F.lit(0.08)),
                    2).cast("decimal(5,2)")
    now = ts_lit(as_of)
    out = j.select(
        (F.lit(CREDIT_ID_BASE) + c("exposure_id")).alias("flag_id"),
        F.lit("CREDIT").alias("flag_domain"),
        flag_type.alias("flag_type"),
        severity.alias("severity"),
        F.lit("OPEN").alias("flag_status"),
        "customer_id", "account_id",
        F.lit(None).cast("string").alias("txn_id"),
        field.alias("threshold_field"), value.alias("threshold_value"), limit.alias("threshold_limit"),
        rationale(flag_type).alias("threshold_rationale"),
        credit_payload().alias("evidence_payload"),
        score.alias("flag_score"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return conform(out, RISK_FLAGS_SCHEMA)
