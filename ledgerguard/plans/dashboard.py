"""Dashboard, board and report queries (O-Q9..O-Q29, O-P11, O-A11..O-A15).

Scalar "tiles" that the dashboard fetched with one round trip each are
combined into single jobs: every tile is a one-row aggregate with its own
column; the rows are unioned and collapsed with ``max`` (no joins, no driver
loop).  Lists that feed a report text are bounded top-k lists before they are
collected into one string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions.rules import severity_rank, unactioned
from ledgerguard.plans.queries import MILLION, _as_of_date

c = F.col
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def one_row(*parts: DataFrame) -> DataFrame:
    """Combine single-row frames with disjoint columns into one row (scalar subqueries)."""
    cols = [x for p in parts for x in p.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.agg(*[F.max(x).alias(x) for x in cols])


def _open_fraud(ctx) -> DataFrame:
    return ctx.risk_flags.filter((c("flag_domain") == "FRAUD") & unactioned(c("flag_status")))


def filter_flags(flags: DataFrame, domains: list[str] | None = None,
                 severities: list[str] | None = ("CRITICAL", "HIGH"), min_score: float | None = 65,
                 limit: int | None = 300, limit_first: bool = False) -> DataFrame:
    """O-P11: multi-select domain/severity + minimum score on the unactioned queue.

    ``limit_first=True`` reproduces the dashboard's order (top ``limit`` by score, then filter);
    the default filters first so no matching row is hidden below the cut.
    """
    base = flags.filter(unactioned(c("flag_status")))
    order = [c("flag_score").desc(), c("flag_id")]

    def _filter(df):
        if domains:
            df = df.filter(c("flag_domain").isin(list(domains)))
        if severities:
            df = df.filter(c("severity").isin(list(severities)))
        if min_score is not None:
            df = df.filter(c("flag_score") >= min_score)
        return df

    if limit_first and limit:
        return _filter(base.orderBy(*order).limit(limit))
    out = _filter(base).orderBy(*order)
    return out.limit(limit) if limit else out


def q9_fraud_kpi(ctx) -> DataFrame:
    f = _open_fraud(ctx)
    return f.agg(F.count(F.lit(1)).alias("fraud_flag_count"),
                 F.sum(F.when(c("severity") == "CRITICAL", 1).otherwise(0)).cast("bigint").alias("critical_count"),
                 F.round(F.avg("flag_score"), 1).cast("decimal(18,1)").alias("avg_score"))


def q10_latest_lcr(ctx, bucket: str = "0_7D", scenario: str = "BASE") -> DataFrame:
    p = ctx.liquidity_positions.filter((c("tenor_bucket") == bucket) & (c("stress_scenario") == scenario))
    latest = p.orderBy(c("position_date").desc()).limit(1)
    pct = F.round(c("lcr_ratio") * 100, 1).cast("decimal(18,1)")
    return latest.select(pct.alias("lcr_pct"), "lcr_breach", "position_date",
                         F.when(c("lcr_breach"), "BREACH").when(pct < 110, "AMBER").otherwise("GREEN")
                         .alias("rag_state"))


def q11_credit_kpi(ctx) -> DataFrame:
    e = ctx.credit_exposures.filter(c("watch_list_flag"))
    return e.agg(F.count(F.lit(1)).alias("watch_list_count"),
                 F.round(F.sum("rwa") * MILLION(), 1).cast("decimal(18,1)").alias("rwa_millions"),
                 F.round(F.avg("pd_score") * 100, 1).cast("decimal(18,1)").alias("avg_pd_pct"))


def q12_case_kpi(ctx) -> DataFrame:
    k = ctx.cases.filter(~c("status").isin("RESOLVED", "CLOSED"))
    return k.agg(F.count(F.lit(1)).alias("open_cases"),
                 F.sum(F.when(c("sla_breach"), 1).otherwise(0)).cast("bigint").alias("sla_breaches"))


def q13_unactioned_flags(ctx, limit: int = 300) -> DataFrame:
    f = ctx.risk_flags.filter(unactioned(c("flag_status")))
    return (f.select("flag_id", "flag_domain", "flag_type", "severity", "account_id", "customer_id",
                     F.round(c("flag_score"), 1).cast("decimal(18,1)").alias("score"),
                     F.left(c("threshold_rationale"), F.lit(110)).alias("rationale"), "flag_status")
             .orderBy(c("score").desc(), c("flag_id")).limit(limit))


def q13_filtered(ctx) -> DataFrame:
    """O-P11 with the dashboard defaults (CRITICAL+HIGH, score >= 65), filtered first."""
    return filter_flags(ctx.risk_flags).select("flag_id", "flag_domain", "flag_type", "severity", "flag_score")


def q13_limit_first(ctx) -> DataFrame:
    """O-P11 reproducing the dashboard's top-300-then-filter order."""
    return filter_flags(ctx.risk_flags, limit_first=True).select(
        "flag_id", "flag_domain", "flag_type", "severity", "flag_score")


def _lcr_series(ctx, days: int = 30):
    return ctx.liquidity_positions.filter(
        (c("tenor_bucket") == "0_7D") & (c("stress_scenario") == "BASE")
        & (c("position_date") >= F.date_sub(_as_of_date(ctx), days)))


def q14_lcr_series(ctx) -> DataFrame:
    s = _lcr_series(ctx)
    pct = F.round(c("lcr_ratio") * 100, 1).cast("decimal(18,1)")
    return s.select("position_date", pct.alias("lcr_pct"), F.lit(100.0).cast("decimal(18,1)").alias("floor_pct"),
                    F.coalesce(pct < 100, F.lit(False)).alias("below_floor"))


def q14_trend_summary(ctx, max_listed: int = 8) -> DataFrame:
    """O-A13: min/max/avg of the series, breach count, first breach days (bounded list)."""
    s = _lcr_series(ctx).select("position_date", F.round(c("lcr_ratio") * 100, 1).alias("pct"))
    # the listed breaches are a top-k (earliest first) taken before anything is gathered into a row
    first = (s.filter(c("pct") < 100).orderBy("position_date", "pct").limit(max_listed)
              .agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("position_date", "pct"))),
                  lambda x: F.concat(x["position_date"].cast("string"), F.lit("="), x["pct"].cast("string"))), "; ")
                  .alias("breach_list")))
    stats = s.agg(F.min("pct").cast("decimal(18,1)").alias("min_pct"),
                  F.max("pct").cast("decimal(18,1)").alias("max_pct"),
                  F.round(F.avg("pct"), 1).cast("decimal(18,1)").alias("avg_pct"),
                  F.count("pct").alias("n_days"),
                  F.sum(F.when(c("pct") < 100, 1).otherwise(0)).cast("bigint").alias("breach_days"))
    return one_row(stats, first).select("min_pct", "max_pct", "avg_pct", "n_days", "breach_days", "breach_list")


def audit_timeline(audit: DataFrame, search: str | None = None, action_types: list[str] | None = None,
                   roles: list[str] | None = None, limit: int = 150) -> DataFrame:
    """O-Q15 / O-P8: newest first by event time (log id as tiebreak); literal, case-insensitive search."""
    a = audit
    if action_types:
        a = a.filter(c("action_type").isin(list(action_types)))
    if roles:
        a = a.filter(c("actor_role").isin(list(roles)))
    if search:
        a = a.filter(F.coalesce(F.contains(F.lower(c("change_summary")), F.lit(search.lower())), F.lit(False)))
    out = (a.select("log_id", "actor_user", "actor_role", "action_type", "object_type", "object_id",
                    "change_summary", c("event_ts").cast("string").alias("et"))
            .orderBy(c("et").desc(), c("log_id").desc()))
    return out.limit(limit) if limit else out


def q15_audit_timeline(ctx) -> DataFrame:
    return audit_timeline(ctx.audit_log)


def q15_audit_search(ctx) -> DataFrame:
    return audit_timeline(ctx.audit_log, search="FROZEN", action_types=["FLAG_ACCOUNT", "FILE_SAR"])


def q16_recent_actions(ctx, n: int = 4) -> DataFrame:
    a = ctx.audit_log
    return (a.select("action_type", "object_type", "object_id",
                     F.left(c("change_summary"), F.lit(70)).alias("cs"),
                     F.left(c("event_ts").cast("string"), F.lit(16)).alias("ts"), "event_ts", "log_id")
             .orderBy(c("event_ts").desc(), c("log_id").desc()).limit(n).drop("event_ts", "log_id"))


def q17_funnel(ctx) -> DataFrame:
    """O-A12: five scalar counts in one row."""
    return one_row(
        ctx.transactions.agg(F.count_if(c("is_flagged")).alias("txn_flagged")),
        ctx.risk_flags.agg(F.count_if(unactioned(c("flag_status"))).alias("open_flags")),
        ctx.filings.agg(F.count(F.lit(1)).alias("filings")),
        ctx.cases.agg(F.count_if(~c("status").isin("RESOLVED", "CLOSED")).alias("cases")),
        ctx.audit_log.agg(F.count(F.lit(1)).alias("audits")))


def q18_flag_pivot(ctx) -> DataFrame:
    """O-A11: domain x severity counts with fixed, ordered severity columns."""
    return (ctx.risk_flags.groupBy("flag_domain").pivot("severity", SEVERITY_ORDER).count()
            .na.fill(0, SEVERITY_ORDER))


def q19_actions_by_role(ctx, n: int = 8) -> DataFrame:
    a = ctx.audit_log.groupBy("actor_role", "action_type").agg(F.count(F.lit(1)).alias("n"))
    return a.orderBy(c("n").desc(), c("actor_role"), c("action_type")).limit(n)


def q20_watch_rwa(ctx, n: int = 8) -> DataFrame:
    e = ctx.credit_exposures.filter(c("watch_list_flag"))
    g = e.groupBy("sector", "internal_rating").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("rwa") * MILLION(), 1).cast("decimal(18,1)").alias("rwa_m"))
    return g.orderBy(c("rwa_m").desc(), c("sector"), c("internal_rating")).limit(n)


def q21_top_fraud_context(ctx, n: int = 10) -> DataFrame:
    """O-J4: two left joins with 'Unknown' defaults."""
    f = _open_fraud(ctx)
    cu = ctx.customers.select("customer_id", "full_name", "pep_flag")
    a = ctx.accounts.select("account_id", c("status").alias("acct_status"))
    top = f.orderBy(c("flag_score").desc(), c("flag_id")).limit(n)
    j = top.join(cu, "customer_id", "left").join(a, "account_id", "left")
    return j.select("flag_id", "flag_type", "account_id", "customer_id",
                    F.round(c("flag_score"), 0).cast("decimal(18,0)").alias("sc"),
                    F.left(c("threshold_rationale"), F.lit(90)).alias("reg"),
                    F.coalesce(c("full_name"), F.lit("Unknown")).alias("nm"),
                    F.coalesce(c("pep_flag").cast("string"), F.lit("false")).alias("pep"), "acct_status")


def q22_board_summary(ctx) -> DataFrame:
    wl = ctx.credit_exposures.filter(c("watch_list_flag"))
    return one_row(
        _open_fraud(ctx).agg(F.count(F.lit(1)).alias("fraud_count")),
        wl.agg(F.count(F.lit(1)).alias("watch_list_count"),
               F.round(F.sum("rwa") * MILLION(), 0).cast("decimal(18,0)").alias("watch_rwa_millions")),
        ctx.liquidity_positions.filter(c("lcr_breach") & (c("tenor_bucket") == "0_7D"))
           .agg(F.countDistinct("position_date").alias("lcr_breach_days")),
        ctx.audit_log.agg(F.count_if(c("action_type") == "FILE_SAR").alias("sar_count")))


def q23_context_bundle(ctx) -> DataFrame:
    """One row with the scalar context and bounded, serialized lists for a report writer."""
    role_rows = (ctx.audit_log.groupBy("actor_role", "action_type").agg(F.count(F.lit(1)).alias("n"))
                 .orderBy(c("n").desc(), c("actor_role"), c("action_type")).limit(8))
    rwa_rows = q20_watch_rwa(ctx)
    docs = ctx.policy_docs.orderBy("doc_id").limit(5)
    latest = q10_latest_lcr(ctx)
    return one_row(
        _open_fraud(ctx).agg(F.count(F.lit(1)).alias("open_fraud_flags")),
        ctx.risk_flags.filter(unactioned(c("flag_status")))
           .agg(F.count_if(c("severity") == "CRITICAL").alias("critical_flags")),
        latest.select(F.concat(c("lcr_pct").cast("string"), F.lit("%"),
                               F.when(c("lcr_breach"), " BREACH").otherwise(" OK")).alias("lcr_state")),
        ctx.credit_exposures.filter(c("watch_list_flag")).agg(
            F.count(F.lit(1)).alias("watch_list_count"),
            F.round(F.sum("rwa") * MILLION(), 0).cast("decimal(18,0)").alias("watch_rwa_millions")),
        ctx.cases.agg(F.count_if(~c("status").isin("RESOLVED", "CLOSED")).alias("open_cases")),
        ctx.audit_log.agg(F.count_if(c("action_type") == "FILE_SAR").alias("sars_filed")),
        role_rows.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-c("n")).alias("k"), "actor_role", "action_type", "n"))),
            lambda x: F.concat(x["actor_role"], F.lit(":"), x["action_type"], F.lit("="), x["n"].cast("string"))),
            " | ").alias("actions_by_role")),
        rwa_rows.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-c("rwa_m")).alias("k"), "sector", "internal_rating", "n",
                                                 "rwa_m"))),
            lambda x: F.concat(x["sector"], F.lit("/"), x["internal_rating"], F.lit(": "), x["n"].cast("string"),
                               F.lit(" facilities, $"), x["rwa_m"].cast("string"), F.lit("M RWA"))),
            " | ").alias("rwa_by_sector")),
        docs.agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("doc_id", "title", F.left(c("content"), F.lit(200)).alias("s")))),
            lambda x: F.concat(x["title"], F.lit(": "), x["s"])), " | ").alias("policy_snippets")),
    )


def q24_pattern_distribution(ctx) -> DataFrame:
    t = ctx.transactions.filter(c("is_flagged"))
    return (t.groupBy("fraud_pattern").agg(F.count(F.lit(1)).alias("cnt"),
                                             F.round(F.avg("flag_score"), 1).cast("decimal(18,1)").alias("avg_score"))
             .orderBy(c("cnt").desc(), c("fraud_pattern")))


def q25_open_by_domain_severity(ctx) -> DataFrame:
    f = ctx.risk_flags.filter(c("flag_status") == "OPEN")
    return (f.groupBy("flag_domain", "severity").agg(F.count(F.lit(1)).alias("cnt"))
             .orderBy(severity_rank(c("severity")), c("flag_domain")))


def q26_flag_distribution(ctx) -> DataFrame:
    f = ctx.risk_flags
    return (f.groupBy("flag_domain").agg(F.count(F.lit(1)).alias("flag_count"),
                                          F.round(F.avg("flag_score"), 1).cast("decimal(18,1)").alias("avg_score"))
             .orderBy(c("flag_count").desc(), c("flag_domain")))


def q27_liquidity_summary(ctx, bucket: str = "0_7D") -> DataFrame:
    p = ctx.liquidity_positions.filter(c("tenor_bucket") == bucket)
    return p.agg(F.countDistinct("position_date").alias("total_days"),
                 F.sum(F.when(c("lcr_breach"), 1).otherwise(0)).cast("bigint").alias("breach_positions"),
                 F.round(F.avg("lcr_ratio") * 100, 1).cast("decimal(18,1)").alias("avg_lcr_pct"),
                 F.round(F.min("lcr_ratio") * 100, 1).cast("decimal(18,1)").alias("min_lcr_pct"))


def q28_chain_steps(ctx) -> DataFrame:
    """O-U1: five step rows, UNION ALL of counts."""
    def step(df: DataFrame, name: str, source: str, suffix: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("step"), F.lit(source).alias("source"),
            F.concat(c("n").cast("string"), F.lit(suffix)).alias("detail"))
    first = ctx.risk_flags.filter(c("severity") == "CRITICAL").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("1_SIGNAL").alias("step"), F.lit("RISK_FLAGS").alias("source"),
        F.concat(c("n").cast("string"), F.lit(" critical flags")).alias("detail"))
    parts = [
        first,
        step(ctx.filings.filter(c("filing_type") == "SAR"), "2_SAR_COUNT", "REGULATORY_FILINGS", " SAR drafts on file"),
        step(ctx.accounts.filter(c("status") == "FROZEN"), "3_FROZEN", "ACCOUNTS", " accounts currently FROZEN"),
        step(ctx.cases.filter(c("status") == "ESCALATED"), "4_ESCALATED", "CASE_ESCALATIONS", " cases ESCALATED"),
        step(ctx.audit_log, "5_AUDIT", "AUDIT_LOG", " immutable audit entries"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("step")


def q29_latest_open_case(ctx) -> DataFrame:
    """Latest unresolved case per account, set-based: max_by aggregates partially (skew-safe)."""
    k = ctx.cases.filter(~c("status").isin("RESOLVED", "CLOSED"))
    g = k.groupBy("account_id").agg(
        F.max_by(F.struct("case_id", "case_type", "severity", "status"), F.struct("created_at", "case_id")).alias("x"),
        F.count(F.lit(1)).alias("open_cases"))
    return g.select("account_id", "x.case_id", "x.case_type", "x.severity", "x.status", "open_cases")


def action_tallies(ctx) -> DataFrame:
    """O-A15: SARs filed, accounts frozen, cases escalated - three conditional counts, one pass."""
    a = ctx.audit_log
    return a.agg(F.count_if(c("action_type") == "FILE_SAR").alias("sars"),
                 F.count_if(c("action_type") == "FLAG_ACCOUNT").alias("freezes"),
                 F.count_if(c("action_type") == "ESCALATE_CASE").alias("escalations"))


def top_critical_for_action(ctx, n: int = 3) -> DataFrame:
    """O-T5: the top critical unactioned flags offered for one-click action."""
    f = ctx.risk_flags.filter((c("severity") == "CRITICAL") & unactioned(c("flag_status")))
    return (f.orderBy(c("flag_score").desc(), c("flag_id")).limit(n)
             .select("flag_id", "flag_domain", "flag_type", "account_id", "customer_id", "flag_score"))


def distinct_rationales(ctx) -> DataFrame:
    """O-P13: SELECT DISTINCT flag type and citation for one domain."""
    return (ctx.risk_flags.filter(c("flag_domain") == "FRAUD").select("flag_type", "threshold_rationale")
            .distinct().orderBy("flag_type"))


ENTRIES = {
    "q9": q9_fraud_kpi, "q10": q10_latest_lcr, "q11": q11_credit_kpi, "q12": q12_case_kpi,
    "q13": q13_unactioned_flags, "q13_filtered": q13_filtered, "q13_limit_first": q13_limit_first,
    "q14": q14_lcr_series, "q14_summary": q14_trend_summary, "q15": q15_audit_timeline,
    "q15_search": q15_audit_search, "q16": q16_recent_actions, "q17": q17_funnel, "q18": q18_flag_pivot,
    "q19": q19_actions_by_role, "q20": q20_watch_rwa, "q21": q21_top_fraud_context, "q22": q22_board_summary,
    "q23": q23_context_bundle, "q24": q24_pattern_distribution, "q25": q25_open_by_domain_severity,
    "q26": q26_flag_distribution, "q27": q27_liquidity_summary, "q28": q28_chain_steps,
    "q29": q29_latest_open_case, "distinct_rationales": distinct_rationales,
    "action_tallies": action_tallies, "top_critical_for_action": top_critical_for_action,
}
