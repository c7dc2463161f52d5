"""Declared schemas of the bank tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, B, D = T.LongType(), T.StringType(), T.BooleanType(), T.DateType()
TS = T.TimestampNTZType()
ARR = T.ArrayType(T.StringType())


def dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


MONEY = dec(18, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BANK_SCHEMAS = {
    "customers": _schema(
        ("customer_id", L), ("full_name", S), ("date_of_birth", D), ("national_id", S), ("segment", S),
        ("kyc_status", S), ("kyc_expiry_date", D), ("country_of_birth", S), ("nationality", S),
        ("pep_flag", B), ("sanction_flag", B), ("risk_rating", S), ("onboarded_date", D),
        ("relationship_mgr", S), ("email", S), ("phone", S), ("created_at", TS)),
    "accounts": _schema(
        ("account_id", L), ("customer_id", L), ("account_number", S), ("account_type", S), ("currency", S),
        ("balance", MONEY), ("credit_limit", MONEY), ("utilisation_pct", dec(5, 2)), ("status", S),
        ("npa_flag", B), ("npa_classification", S), ("open_date", D), ("last_txn_date", D),
        ("avg_monthly_balance", MONEY), ("branch_code", S), ("ifsc_code", S), ("created_at", TS)),
    "transactions": _schema(
        ("txn_id", S), ("account_id", L), ("txn_ts", TS), ("amount", MONEY), ("currency", S),
        ("txn_type", S), ("channel", S), ("counterparty_account", S), ("counterparty_name", S),
        ("country_code", S), ("txn_category", S), ("reference_no", S), ("created_at", TS)),
    "credit_exposures": _schema(
        ("exposure_id", L), ("customer_id", L), ("account_id", L), ("facility_type", S),
        ("outstanding", MONEY), ("credit_limit", MONEY), ("utilisation_pct", dec(5, 2)),
        ("pd_score", dec(6, 4)), ("lgd", dec(6, 4)), ("ead", MONEY), ("risk_weight_pct", dec(6, 2)),
        ("internal_rating", S), ("collateral_type", S), ("collateral_value", MONEY), ("sector", S),
        ("maturity_date", D), ("origination_date", D), ("last_review_date", D), ("created_at", TS)),
    "liquidity_positions": _schema(
        ("position_id", L), ("position_date", D), ("tenor_bucket", S), ("inflow", MONEY), ("outflow", MONEY),
        ("hqla_level1", MONEY), ("hqla_level2", MONEY), ("lcr_denominator", MONEY),
        ("nsfr_ratio", dec(18, 4)), ("stress_scenario", S), ("created_at", TS)),
    "regulatory_filings": _schema(
        ("filing_id", L), ("customer_id", L), ("account_id", L), ("filing_type", S), ("filing_status", S),
        ("filing_date", D), ("submitted_date", D), ("regulatory_body", S), ("filed_by", S),
        ("assigned_to", S), ("narrative", S), ("linked_txn_ids", ARR), ("amount_involved", MONEY),
        ("risk_score", dec(5, 2)), ("outcome", S), ("reference_case_id", S), ("created_at", TS),
        ("updated_at", TS)),
    "case_escalations": _schema(
        ("case_id", L), ("customer_id", L), ("account_id", L), ("linked_filing_id", L), ("linked_flag_id", L),
        ("case_type", S),
        ("severity", S), ("status", S), ("assigned_to", S), ("escalated_to", S), ("created_by", S),
        ("created_at", TS), ("updated_at", TS), ("due_date", D), ("sla_breach", B),
        ("resolution_notes", S), ("evidence_txn_ids", ARR), ("tags", ARR)),
    "audit_log": _schema(
        ("log_id", L), ("event_ts", TS), ("actor_user", S), ("actor_role", S), ("action_type", S),
        ("object_type", S), ("object_id", S), ("before_state", S), ("after_state", S),
        ("change_summary", S), ("source_ip", S), ("session_id", S), ("request_id", S)),
    "policy_docs": _schema(
        ("doc_id", L), ("title", S), ("doc_type", S), ("source", S), ("effective_date", D),
        ("content", S), ("tags", ARR), ("lang", S), ("created_at", TS)),
}

RISK_FLAGS_SCHEMA = _schema(
    ("flag_id", L), ("flag_domain", S), ("flag_type", S), ("severity", S), ("flag_status", S),
    ("customer_id", L), ("account_id", L), ("txn_id", S), ("evidence_txn_ids", ARR),
    ("threshold_field", S), ("threshold_value", dec(14, 4)), ("threshold_limit", dec(14, 4)),
    ("threshold_rationale", S), ("evidence_payload", S), ("flag_score", dec(5, 2)),
    ("created_at", TS), ("updated_at", TS), ("actioned_by", S), ("action_taken", S))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: declared order and types; missing columns are NULL.

    Built as one ``selectExpr`` (one JVM call) rather than one Column object per field."""
    cols = set(df.columns)
    return df.selectExpr(*[
        f"CAST({'`' + f.name + '`' if f.name in cols else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for f in schema.fields
    ])


def load(spark, path: str, table: str) -> DataFrame:
    """O-S1: scan a stored bank table with its declared schema."""
    schema = RISK_FLAGS_SCHEMA if table == "risk_flags" else BANK_SCHEMAS[table]
    return spark.read.schema(schema).parquet(path)


# --- fixed values: the declared columns of the raw inputs; scans use them instead of reading file footers ---
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}
