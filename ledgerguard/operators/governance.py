"""Masking, row filters, secure views and effective access (O-G1..O-G7).

The role is a literal of the request, so every mask is a plain Column
expression that Catalyst folds; masking is applied by :func:`secure_view`
*before* the caller projects anything, so no projection can reach a raw value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K

c = F.col

FULL_PII_ROLES = {K.ROLE_ADMIN, K.ROLE_COMPLIANCE, K.ROLE_MANAGER, K.ROLE_PLATFORM}
FULL_ACCOUNT_ROLES = {K.ROLE_ADMIN, K.ROLE_COMPLIANCE, K.ROLE_PLATFORM}
PARTIAL_ACCOUNT_ROLES = {K.ROLE_MANAGER, K.ROLE_AUDITOR}
ALL_FILINGS_ROLES = {K.ROLE_ADMIN, K.ROLE_COMPLIANCE, K.ROLE_AUDITOR, K.ROLE_PLATFORM}
SAR_ROLES = {K.ROLE_COMPLIANCE, K.ROLE_ADMIN, K.ROLE_PLATFORM}
CASE_ROLES = {K.ROLE_MANAGER, K.ROLE_COMPLIANCE, K.ROLE_ADMIN, K.ROLE_PLATFORM}


@dataclass(frozen=True)
class Actor:
    """Who runs an action or reads a view (replaces CURRENT_USER / CURRENT_ROLE)."""
    user: str
    role: str


def mask_national_id(col: Column, role: str) -> Column:
    """O-G1: full for admin/compliance/manager, else 'XXX-XX-' + last 4."""
    return col if role in FULL_PII_ROLES else F.concat(F.lit("XXX-XX-"), F.right(col, F.lit(4)))


def mask_account_number(col: Column, role: str) -> Column:
    """O-G2: full / 'XXXX-' + last 4 (manager, auditor) / 'XXXX-XXXX-' + last 4."""
    if role in FULL_ACCOUNT_ROLES:
        return col
    if role in PARTIAL_ACCOUNT_ROLES:
        return F.concat(F.lit("XXXX-"), F.right(col, F.lit(4)))
    return F.concat(F.lit("XXXX-XXXX-"), F.right(col, F.lit(4)))


def mask_full_name(col: Column, role: str) -> Column:
    """O-G3: full / first word + ' ***'."""
    return col if role in FULL_PII_ROLES else F.concat(F.split_part(col, F.lit(" "), F.lit(1)), F.lit(" ***"))


def row_filter_filings(filings: DataFrame, actor: Actor, domain: str = K.BANK_DOMAIN) -> DataFrame:
    """O-G4: all rows for admin/compliance/auditor; a manager sees own or in-house assignments; else none."""
    if actor.role in ALL_FILINGS_ROLES:
        return filings
    if actor.role == K.ROLE_MANAGER:
        return filings.filter((c("assigned_to") == F.lit(actor.user)) | c("assigned_to").endswith(domain))
    return filings.filter(F.lit(False))


# table -> {column: mask function}
MASK_CATALOG = {
    "customers": {"national_id": mask_national_id, "full_name": mask_full_name},
    "accounts": {"account_number": mask_account_number},
}
# tables a role may not read at all
DENIED = {K.ROLE_ANALYST: {"regulatory_filings", "audit_log"}}


def secure_view(table: str, df: DataFrame, actor: Actor) -> DataFrame:
    """O-G5: the table as ``actor`` may see it: masks first, then row policy, then grants."""
    if table in DENIED.get(actor.role, set()) or actor.role not in K.ALL_ROLES:
        return df.filter(F.lit(False))
    masks = MASK_CATALOG.get(table, {})
    out = df.select([masks[x](c(x), actor.role).alias(x) if x in masks else c(x) for x in df.columns])
    if table == "regulatory_filings":
        out = row_filter_filings(out, actor)
    return out


# --- fixed values: grants (role, privilege, object) ---------------------------
_READ_ALL = ["customers", "accounts", "transactions", "credit_exposures", "liquidity_positions",
             "regulatory_filings", "case_escalations", "audit_log", "risk_flags", "policy_docs"]
GRANTS = (
    [(K.ROLE_ANALYST, "SELECT", t) for t in ["customers", "accounts", "transactions", "credit_exposures",
                                               "liquidity_positions", "case_escalations", "risk_flags"]]
    + [(K.ROLE_AUDITOR, "SELECT", t) for t in _READ_ALL]
    + [(K.ROLE_MANAGER, "SELECT", t) for t in _READ_ALL]
    + [(K.ROLE_MANAGER, "UPDATE", "accounts"), (K.ROLE_MANAGER, "INSERT", "case_escalations"),
       (K.ROLE_MANAGER, "UPDATE", "case_escalations"), (K.ROLE_MANAGER, "EXECUTE", "FLAG_ACCOUNT"),
       (K.ROLE_MANAGER, "EXECUTE", "ESCALATE_CASE")]
    + [(K.ROLE_COMPLIANCE, "INSERT", "regulatory_filings"), (K.ROLE_COMPLIANCE, "UPDATE", "regulatory_filings"),
       (K.ROLE_COMPLIANCE, "EXECUTE", "FILE_SAR")]
    + [(K.ROLE_ADMIN, "ALL", t) for t in _READ_ALL]
)


def role_edges_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.ROLE_EDGES, "child string, parent string")


def grants_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, "role string, privilege string, object string")


def role_closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(role, inherited_role) pairs incl. (r, r): parents inherit every child grant, transitively.

    A recursive CTE over the edge relation; the edge set is the catalog's role graph.  A graph deeper than
    64 (a cycle, in practice) is an error, not a shorter closure.
    """
    edges.createOrReplaceTempView("_lg_role_edges")
    return spark.sql("""
        WITH RECURSIVE closure(role, inherited, depth) AS (
          SELECT parent, child, 1 FROM _lg_role_edges
          UNION ALL
          SELECT c.role, e.child, c.depth + 1 FROM closure c JOIN _lg_role_edges e ON e.parent = c.inherited
          WHERE c.depth < 64
        )
        SELECT DISTINCT role, IF(depth >= 64, raise_error('role graph deeper than 64: has it a cycle?'), inherited) AS inherited
        FROM closure
        UNION SELECT child, child FROM _lg_role_edges
        UNION SELECT parent, parent FROM _lg_role_edges
    """)


def effective_access(spark: SparkSession, edges: DataFrame, grants: DataFrame) -> DataFrame:
    """O-G6: every (role, privilege, object) a role holds directly or through inheritance."""
    cl = role_closure(spark, edges)
    g = grants.withColumnRenamed("role", "inherited")
    return cl.join(g, "inherited").select("role", "privilege", "object", "inherited").distinct()


ACTION_PRIVILEGE = {"FILE_SAR": "FILE_SAR", "FLAG_ACCOUNT": "FLAG_ACCOUNT", "ESCALATE_CASE": "ESCALATE_CASE"}


def audit_authorization(spark: SparkSession, audit: DataFrame) -> DataFrame:
    """Check every audited action against the actor role's effective EXECUTE grants.

    The grant table is a catalog of constant size, so it is broadcast; the audit log streams past it.
    """
    acc = effective_access(spark, role_edges_df(spark), grants_df(spark))
    execs = (acc.filter(c("privilege") == "EXECUTE").select(c("role").alias("actor_role"),
                                                            c("object").alias("action_type"))
             .distinct().withColumn("authorized", F.lit(True)))
    j = audit.join(F.broadcast(execs), ["actor_role", "action_type"], "left")
    return (j.withColumn("authorized", F.coalesce(c("authorized"), F.lit(False)))
             .groupBy("actor_role", "action_type", "authorized").agg(F.count(F.lit(1)).alias("n")))


def role_gate(requests: DataFrame, actor: Actor, allowed: set[str], message: str) -> tuple[DataFrame, DataFrame]:
    """O-G7: split a request batch into (admitted, rejected-with-error) by the actor's role."""
    if actor.role in allowed:
        return requests, requests.filter(F.lit(False)).withColumn("error", F.lit(message))
    return requests.filter(F.lit(False)), requests.withColumn("error", F.lit(message))
