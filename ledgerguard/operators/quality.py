"""Data-quality checks (O-DQ1..O-DQ5).

Spark does not enforce declared keys, so they are checked: counts, key
uniqueness (a grouped count, partial-aggregated), foreign-key orphans
(``left_anti``) and value domains (one conditional-count pass per table).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.operators.governance import MASK_CATALOG

c = F.col

# --- fixed values: lower bounds per table (the seeded sizes of the reference data)
EXPECTED_MIN_ROWS = {
    "customers": 500, "accounts": 800, "transactions": 50000, "credit_exposures": 300,
    "liquidity_positions": 450, "regulatory_filings": 200, "case_escalations": 50, "audit_log": 0,
    "risk_flags": 1, "policy_docs": 10,
}

PRIMARY_KEYS = {
    "customers": ["customer_id"], "accounts": ["account_id"], "transactions": ["txn_id"],
    "credit_exposures": ["exposure_id"], "regulatory_filings": ["filing_id"], "case_escalations": ["case_id"],
    "audit_log": ["log_id"], "risk_flags": ["flag_id"], "policy_docs": ["doc_id"],
    "liquidity_positions": ["position_id"],
}
UNIQUE_KEYS = {"liquidity_positions": ["position_date", "tenor_bucket", "stress_scenario"],
               "accounts": ["account_number"]}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("transactions", "account_id", "accounts", "account_id"),
    ("accounts", "customer_id", "customers", "customer_id"),
    ("credit_exposures", "customer_id", "customers", "customer_id"),
    ("credit_exposures", "account_id", "accounts", "account_id"),
    ("regulatory_filings", "customer_id", "customers", "customer_id"),
    ("regulatory_filings", "account_id", "accounts", "account_id"),
    ("case_escalations", "customer_id", "customers", "customer_id"),
    ("case_escalations", "account_id", "accounts", "account_id"),
    ("case_escalations", "linked_filing_id", "regulatory_filings", "filing_id"),
]


ROWS = "rows"


def profile_columns(name: str) -> list[Column]:
    """The aggregates of a table's profile: its rows, and for each domain check the rows that violate it.  They can be
    observed while the table is written, or computed in one scan."""
    checks = domain_checks().get(name, {})
    return [F.count(F.lit(1)).alias(ROWS)] + [
        F.coalesce(F.sum(F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1)), F.lit(0)).cast("bigint").alias(k)
        for k, p in checks.items()]


def profile(tables: dict[str, DataFrame], observed: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """``table_name``, ``check_name``, ``value`` of every table.  Tables whose profile was observed when they were
    written (``observed``) are not read; each other one is scanned once for its count and all its checks."""
    parts = []
    for name, df in tables.items():
        columns = profile_columns(name)
        names = [ROWS, *domain_checks().get(name, {})]
        if observed and name in observed:
            rows = df.sparkSession.range(1).select(*[F.lit(observed[name][k]).cast("bigint").alias(k) for k in names])
        else:
            rows = df.agg(*columns)
        stack = ", ".join(f"'{k}', `{k}`" for k in names)
        parts.append(rows.selectExpr(f"'{name}' AS table_name", f"stack({len(names)}, {stack}) AS (check_name, value)"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_counts(profiled: DataFrame, expected: dict[str, int] = EXPECTED_MIN_ROWS) -> DataFrame:
    """O-DQ1: one row per table of a :func:`profile`: count, expected lower bound, pass."""
    exp = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v))])
    return (profiled.filter(c("check_name") == ROWS).select("table_name", c("value").alias("n"))
            .withColumn("min_expected", F.coalesce(F.element_at(exp, c("table_name")), F.lit(0)).cast("bigint"))
            .withColumn("meets_minimum", c("n") >= c("min_expected")))


def duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """O-DQ2: number of key values that occur more than once (PK and declared unique keys)."""
    parts = []
    for name, df in tables.items():
        for kind, keys in (("primary", PRIMARY_KEYS.get(name)), ("unique", UNIQUE_KEYS.get(name))):
            if not keys:
                continue
            dup = df.groupBy(*keys).count().filter(c("count") > 1)
            parts.append(dup.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                                 F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("duplicate_rows"))
                         .select(F.lit(name).alias("table_name"), F.lit(kind).alias("key_kind"),
                                 F.lit(",".join(keys)).alias("key_columns"), "duplicate_keys", "duplicate_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """O-DQ3: child rows whose non-NULL foreign key has no parent (``left_anti``)."""
    parts = []
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        ch = tables[child].select(c(ccol).alias("_k")).filter(c("_k").isNotNull())
        pa = tables[parent].select(c(pcol).alias("_k"))
        o = ch.join(pa, "_k", "left_anti")
        parts.append(o.agg(F.count(F.lit(1)).alias("orphans")).select(
            F.lit(f"{child}.{ccol}").alias("child"), F.lit(f"{parent}.{pcol}").alias("parent"), "orphans"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _in(col: str, values) -> Column:
    return c(col).isin(list(values))


def domain_checks() -> dict[str, dict[str, Column]]:
    """Per table: check name -> predicate that must hold (NULL counts as a violation)."""
    return {
        "customers": {
            "segment_domain": _in("segment", K.SEGMENTS), "kyc_domain": _in("kyc_status", K.KYC_STATUSES),
            "rating_domain": _in("risk_rating", K.RISK_RATINGS), "national_id_not_null": c("national_id").isNotNull(),
            "national_id_len": F.length("national_id") <= 20, "full_name_len": F.length("full_name") <= 120},
        "accounts": {
            "type_domain": _in("account_type", K.ACCOUNT_TYPES), "status_domain": _in("status", K.ACCOUNT_STATUSES),
            "currency_len": F.length("currency") == 3, "npa_consistent": c("npa_flag") == (c("status") == "NPA")},
        "transactions": {
            "type_domain": _in("txn_type", ["DEBIT", "CREDIT"]), "channel_domain": _in("channel", K.CHANNELS),
            "amount_not_null": c("amount").isNotNull(), "ts_not_null": c("txn_ts").isNotNull()},
        "credit_exposures": {
            "pd_range": c("pd_score").between(0, 1), "lgd_range": c("lgd").between(0, 1),
            "rating_domain": _in("internal_rating", K.INTERNAL_RATINGS), "sector_domain": _in("sector", K.SECTORS)},
        "liquidity_positions": {
            "bucket_domain": _in("tenor_bucket", K.TENOR_BUCKETS), "inflow_non_negative": c("inflow") >= 0,
            "outflow_non_negative": c("outflow") >= 0},
        "case_escalations": {
            "severity_domain": _in("severity", K.CASE_SEVERITIES), "status_domain": _in("status", K.CASE_STATUSES),
            "type_domain": _in("case_type", K.CASE_TYPES)},
    }


def domain_violations(profiled: DataFrame) -> DataFrame:
    """O-DQ4: violations per (table, check) of a :func:`profile`."""
    return profiled.filter(c("check_name") != ROWS).select("table_name", "check_name", c("value").alias("violations"))


SENSITIVE = {"customers": ["national_id", "full_name"], "accounts": ["account_number"]}


def masking_coverage(tables: dict[str, DataFrame], roles: list[str] = K.ALL_ROLES) -> DataFrame:
    """O-DQ5: for each role and sensitive column, how many values the role sees unmasked.

    One aggregation pass per table: every role's mask (the same catalog ``secure_view`` applies)
    is compared with the raw value in the same row, so no self-join is needed."""
    parts = []
    for table, cols in SENSITIVE.items():
        raw = tables[table]
        aggs, names = [], []
        for ri, role in enumerate(roles):
            view_cols = {x: MASK_CATALOG[table][x](c(x), role) for x in cols}
            for x in cols:
                names.append((role, x, f"_lg_{ri}_{x}"))
                aggs.append(F.sum(F.when(view_cols[x] == c(x), 1).otherwise(0)).cast("bigint").alias(f"_lg_{ri}_{x}"))
        agg = raw.agg(*aggs, F.count(F.lit(1)).alias("visible_rows"))
        stack = ", ".join(f"'{role}', '{x}', `{n}`" for role, x, n in names)
        parts.append(agg.selectExpr(f"'{table}' AS table_name",
                                    f"stack({len(names)}, {stack}) AS (role, column_name, unmasked_values)",
                                    "visible_rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def conversation_turn_gaps(conv: DataFrame) -> DataFrame:
    """Turns must be numbered 0..n-1 per conversation (the pairing join relies on it):
    conversations whose turn numbers have gaps, duplicates or do not start at 0."""
    g = conv.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
                                    F.count(F.lit(1)).alias("turns"), F.countDistinct("turn").alias("distinct_turns"))
    bad = (c("first_turn") != 0) | (c("last_turn") - c("first_turn") + 1 != c("turns")) | (c("turns") != c("distinct_turns"))
    return g.agg(F.count(F.lit(1)).alias("conversations"), F.count_if(bad).alias("with_gaps"))
