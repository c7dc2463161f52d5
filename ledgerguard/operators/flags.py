"""Unified risk-flag queue (O-D28, O-D29) and payload re-extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerguard.sources.schemas import RISK_FLAGS_SCHEMA, conform


def union_flags(*flag_frames: DataFrame) -> DataFrame:
    """O-D28: fraud + credit + liquidity flags.  Ids are derived from (domain, source key),
    so re-running the build yields the same ids (no autoincrement, no MAX+1)."""
    frames = [conform(f, RISK_FLAGS_SCHEMA) for f in flag_frames]
    return reduce(lambda a, b: a.unionByName(b), frames)


PAYLOAD_FIELDS = {
    "FRAUD": ["customer_id", "account_id", "txn_id", "amount", "channel", "country_code",
              "fraud_pattern", "flag_score", "txn_ts", "counterparty_account", "review_status"],
    "CREDIT": ["customer_id", "account_id", "exposure_id", "facility_type", "outstanding", "pd_score", "lgd",
               "ead", "expected_loss", "rwa", "sector", "internal_rating", "utilisation_pct", "npa_flag",
               "collateral_type"],
    "LIQUIDITY": ["position_date", "tenor_bucket", "lcr_ratio", "lcr_numerator", "lcr_denominator",
                  "nsfr_ratio", "hqla_level1", "hqla_level2", "inflow", "outflow", "stress_scenario",
                  "lcr_breach", "nsfr_breach"],
}


def payload_field(name: str, cast: str | None = None):
    v = F.get_json_object(F.col("evidence_payload"), f"$.{name}")
    return v.cast(cast) if cast else v
