"""Oracle SQL (DuckDB) for every registered query, keyed like ``queries()``."""

from __future__ import annotations

from oracle.ctes import AS_OF, with_ctes

ORACLE: dict[str, str] = {}


def register(name: str, query: str, *needs: str):
    ORACLE[name] = with_ctes(query, *needs)


def avg_dec(expr: str, scale: int) -> str:
    """DuckDB's avg(decimal) is a double; bring it back to the exact decimal Spark keeps."""
    return f"CAST(AVG({expr}) AS DECIMAL(38,{scale}))"


# ---- verified queries -------------------------------------------------------
# fixed values: the output columns, limits and orders of q1 to q8 are the documented ones
register("q1", f"""
SELECT t.account_id, a.account_type, c.segment,
  COUNT(*) AS flagged_txn_count,
  CAST(SUM(t.amount) AS DECIMAL(18,2)) AS total_flagged_amount,
  MAX(t.flag_score) AS max_flag_score,
  string_agg(DISTINCT t.fraud_pattern, ',' ORDER BY t.fraud_pattern) AS patterns
FROM transactions t
JOIN accounts a ON a.account_id = t.account_id
JOIN customers c ON c.customer_id = a.customer_id
WHERE t.is_flagged AND t.txn_ts >= {AS_OF} - INTERVAL 7 DAYS
GROUP BY t.account_id, a.account_type, c.segment
ORDER BY max_flag_score DESC, t.account_id
LIMIT 20""", "transactions", "accounts", "customers")

register("q2", f"""
SELECT position_date,
  CAST(ROUND({avg_dec('lcr_ratio', 8)} * 100, 1) AS DECIMAL(18,1)) AS avg_lcr_pct,
  MAX(CASE WHEN lcr_breach THEN 1 ELSE 0 END) AS had_breach
FROM positions
WHERE position_date >= CAST({AS_OF} AS DATE) - 30 AND tenor_bucket = '0_7D'
GROUP BY position_date ORDER BY position_date""", "positions")

register("q3", f"""
SELECT sector, COUNT(*) AS watch_list_count,
  CAST(ROUND(SUM(outstanding) * 0.000001, 2) AS DECIMAL(18,2)) AS outstanding_millions,
  CAST(ROUND(SUM(rwa) * 0.000001, 2) AS DECIMAL(18,2)) AS rwa_millions,
  CAST(ROUND({avg_dec('pd_score', 8)} * 100, 2) AS DECIMAL(18,2)) AS avg_pd_pct,
  CAST(ROUND(SUM(expected_loss) * 0.000001, 4) AS DECIMAL(18,4)) AS ecl_millions
FROM exposures WHERE watch_list_flag
GROUP BY sector ORDER BY outstanding_millions DESC, sector""", "exposures")

register("q4", f"""
SELECT c.customer_id, c.segment, c.risk_rating, c.pep_flag, c.sanction_flag,
  COUNT(DISTINCT t.txn_id) AS flagged_txn_count,
  MAX(t.flag_score) AS max_fraud_score,
  string_agg(DISTINCT t.fraud_pattern, ',' ORDER BY t.fraud_pattern) AS fraud_patterns
FROM customers c
JOIN accounts a ON a.customer_id = c.customer_id
JOIN transactions t ON t.account_id = a.account_id
WHERE c.risk_rating = 'HIGH' AND t.is_flagged AND t.txn_ts >= {AS_OF} - INTERVAL 7 DAYS
GROUP BY c.customer_id, c.segment, c.risk_rating, c.pep_flag, c.sanction_flag
ORDER BY max_fraud_score DESC, c.customer_id
LIMIT 20""", "customers", "accounts", "transactions")

register("q5", f"""
SELECT flag_domain, severity, flag_type, COUNT(*) AS flag_count,
  CAST(ROUND({avg_dec('flag_score', 6)}, 1) AS DECIMAL(18,1)) AS avg_score
FROM risk_flags WHERE flag_status = 'OPEN'
GROUP BY flag_domain, severity, flag_type""", "risk_flags")

register("q6", """
SELECT t.txn_id, t.account_id, c.customer_id, c.segment, c.pep_flag, t.amount, t.channel, t.txn_ts,
  t.flag_score, t.country_code
FROM transactions t
JOIN accounts a ON a.account_id = t.account_id
JOIN customers c ON c.customer_id = a.customer_id
WHERE t.fraud_pattern = 'STRUCTURING'
ORDER BY t.txn_ts DESC, t.txn_id LIMIT 50""", "transactions", "accounts", "customers")

register("q7", f"""
SELECT sector, internal_rating, COUNT(*) AS facility_count,
  CAST(ROUND(SUM(outstanding) * 0.000001, 2) AS DECIMAL(18,2)) AS outstanding_millions,
  CAST(ROUND(SUM(rwa) * 0.000001, 2) AS DECIMAL(18,2)) AS rwa_millions,
  CAST(ROUND({avg_dec('pd_score', 8)} * 100, 2) AS DECIMAL(18,2)) AS avg_pd_pct
FROM exposures GROUP BY sector, internal_rating
ORDER BY rwa_millions DESC, sector, internal_rating LIMIT 30""", "exposures")

register("q8", """
SELECT position_date, tenor_bucket,
  CAST(ROUND(lcr_ratio * 100, 1) AS DECIMAL(18,1)) AS lcr_pct,
  CAST(ROUND(lcr_numerator * 0.000001, 1) AS DECIMAL(18,1)) AS hqla_millions,
  CAST(ROUND(lcr_denominator * 0.000001, 1) AS DECIMAL(18,1)) AS net_outflow_millions,
  nsfr_breach
FROM positions WHERE lcr_breach
ORDER BY position_date DESC, lcr_ratio ASC, position_id LIMIT 50""", "positions")


# ---- detection layer --------------------------------------------------------
register("velocity", """
SELECT txn_id, account_id, txn_ts, velocity_count, velocity_count >= 5 AS is_velocity
FROM tx_rules""", "tx_rules")

register("flag_id_registry", """
SELECT flag_type, COUNT(*) AS n_flags, COUNT(DISTINCT txn_id) AS n_ids, 0 AS moved, 0 AS shared FROM fraud_flags GROUP BY 1""", "fraud_flags")
register("velocity_dense", "SELECT txn_id, account_id, txn_ts, velocity_count FROM tx_rules", "tx_rules")
register("velocity_hour", """
SELECT txn_id, account_id, txn_ts, velocity_count FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY account_id ORDER BY txn_ts
      RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS velocity_count FROM tx_raw)
WHERE velocity_count >= 3""", "tx_raw")
register("velocity_burst", """
SELECT txn_id, account_id, velocity_count, velocity_count >= 5 AS is_velocity,
  MAX(velocity_count) OVER (PARTITION BY account_id ORDER BY txn_ts
      RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) >= 5 AS is_velocity_burst
FROM tx_rules""", "tx_rules")

for _name, _col in [("structuring", "is_structuring"), ("cross_border", "high_risk_country"),
                    ("round_number", "is_round_number")]:
    register(_name, f"""
SELECT txn_id, account_id, amount, country_code, {_col} AS hit
FROM transactions WHERE {_col}""", "transactions")

register("classify_fraud", """
SELECT txn_id, fraud_pattern, pattern_list, is_flagged, flag_score, review_status, reviewed_by
FROM transactions""", "transactions")

register("classify_summary", """
SELECT fraud_pattern, review_status, COUNT(*) AS n, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
FROM transactions GROUP BY fraud_pattern, review_status""", "transactions")

register("fraud_flags", """
SELECT flag_id, flag_type, severity, flag_status, customer_id, account_id, txn_id,
  threshold_field, threshold_value, threshold_limit, flag_score
FROM fraud_flags""", "fraud_flags")

register("credit_derive", """
SELECT exposure_id, expected_loss, rwa, watch_list_flag, utilisation_pct,
  coalesce(utilisation_pct > 90, false) AS utilisation_breach
FROM exposures""", "exposures")

register("credit_flags", """
SELECT flag_id, flag_type, severity, customer_id, account_id, threshold_field, threshold_value,
  threshold_limit, flag_score
FROM credit_flags""", "credit_flags")

register("liquidity_ratios", """
SELECT position_id, position_date, tenor_bucket, net_position, hqla_total, lcr_numerator, lcr_ratio,
  lcr_breach, nsfr_ratio, nsfr_breach
FROM positions""", "positions")

register("liquidity_flags", """
SELECT flag_id, flag_type, severity, threshold_field, threshold_value, threshold_limit, flag_score
FROM liquidity_flags""", "liquidity_flags")

SCORE_BAND = ("CASE WHEN flag_score IS NULL THEN NULL WHEN flag_score <= 40 THEN 'low' "
              "WHEN flag_score <= 65 THEN 'medium' ELSE 'high' END")

register("risk_flags", f"""
SELECT flag_id, flag_domain, flag_type, severity, flag_status, customer_id, account_id, txn_id,
  threshold_field, threshold_value, threshold_limit, flag_score, {SCORE_BAND} AS score_band,
  true AS has_rationale
FROM risk_flags""", "risk_flags")

register("flag_payload_fields", """
SELECT flag_id, flag_domain, n_keys, p_amount, p_channel, p_txn_ts, p_review_status,
  CAST(NULL AS BIGINT) AS p_exposure_id, CAST(NULL AS DECIMAL(18,2)) AS p_expected_loss,
  CAST(NULL AS DECIMAL(18,2)) AS p_rwa, CAST(NULL AS BOOLEAN) AS p_npa_flag,
  CAST(NULL AS VARCHAR) AS p_tenor_bucket, CAST(NULL AS DATE) AS p_position_date,
  CAST(NULL AS DECIMAL(18,4)) AS p_lcr_ratio
FROM fraud_flags
UNION ALL
SELECT flag_id, flag_domain, n_keys, NULL, NULL, NULL, NULL, p_exposure_id, p_expected_loss, p_rwa,
  p_npa_flag, NULL, NULL, NULL
FROM credit_flags
UNION ALL
SELECT flag_id, flag_domain, n_keys, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  p_tenor_bucket, p_position_date, p_lcr_ratio
FROM liquidity_flags""", "fraud_flags", "credit_flags", "liquidity_flags")

register("score_band", f"""
SELECT flag_domain, {SCORE_BAND} AS score_band, COUNT(*) AS n
FROM risk_flags GROUP BY 1, 2""", "risk_flags")


# ---- metric layer and named filters ----------------------------------------
def cnt(pred: str) -> str:
    return f"CAST(SUM(CASE WHEN {pred} THEN 1 ELSE 0 END) AS BIGINT)"


def dsum(expr: str, scale: int = 2) -> str:
    return f"CAST(SUM({expr}) AS DECIMAL(18,{scale}))"


def davg(expr: str, in_scale: int, out_scale: int) -> str:
    return f"CAST({avg_dec(expr, in_scale + 4)} AS DECIMAL(18,{out_scale}))"


RATE = ("CAST(((2 * SUM(CASE WHEN is_flagged THEN 1 ELSE 0 END) * 10000 + COUNT(txn_id)) "
        "// (2 * COUNT(txn_id))) * 0.01 AS DECIMAL(18,2))")
TXN_METRICS = (f"{cnt('is_flagged')} AS total_flagged_transactions, "
               f"{dsum('CASE WHEN is_flagged THEN amount ELSE 0 END')} AS total_flagged_amount, "
               f"{RATE} AS flagged_transaction_rate")
FLAG_METRICS = (f"{cnt(chr(39).join(['flag_status = ', 'OPEN', '']))} AS open_flag_count, "
                f"{cnt(chr(39).join(['severity = ', 'CRITICAL', '']))} AS critical_flag_count")
CREDIT_METRICS2 = f"{cnt('watch_list_flag')} AS watch_list_count, {dsum('rwa')} AS total_rwa"

register("metrics_risk_flags", f"""
SELECT {FLAG_METRICS},
  {davg("CASE WHEN flag_domain = 'FRAUD' THEN flag_score END", 2, 6)} AS avg_fraud_score
FROM risk_flags""", "risk_flags")
register("metrics_transactions", f"SELECT {TXN_METRICS} FROM transactions", "transactions")
register("metrics_accounts", f"""
SELECT {cnt('npa_flag')} AS npa_account_count, {dsum('balance')} AS total_balance,
  {davg('CASE WHEN credit_limit IS NOT NULL THEN utilisation_pct END', 2, 6)} AS avg_utilisation
FROM accounts""", "accounts")
register("metrics_customers", f"""
SELECT {cnt("risk_rating = 'HIGH'")} AS high_risk_customer_count, {cnt('pep_flag')} AS pep_customer_count,
  {cnt('sanction_flag')} AS sanctioned_customer_count
FROM customers""", "customers")
register("metrics_credit_exposures", f"""
SELECT {CREDIT_METRICS2}, {dsum('expected_loss')} AS total_expected_loss,
  {davg('pd_score', 4, 8)} AS avg_pd,
  {dsum("CASE WHEN sector = 'REAL_ESTATE' THEN outstanding ELSE 0 END")} AS real_estate_outstanding
FROM exposures""", "exposures")
register("metrics_liquidity_positions", f"""
SELECT {cnt('lcr_breach')} AS lcr_breach_day_count, {davg('lcr_ratio', 4, 8)} AS avg_lcr_ratio,
  {davg(f"CASE WHEN position_date >= CAST({AS_OF} AS DATE) - 30 THEN lcr_ratio END", 4, 8)}
    AS avg_lcr_last_30_days
FROM positions""", "positions")

register("filters_risk_flags", f"""
SELECT {cnt("flag_status = 'OPEN'")} AS open_flags, {cnt("flag_domain = 'FRAUD'")} AS fraud_flags,
  {cnt("flag_domain = 'CREDIT'")} AS credit_flags, {cnt("flag_domain = 'LIQUIDITY'")} AS liquidity_flags,
  {cnt("severity IN ('HIGH', 'CRITICAL')")} AS critical_and_high_flags
FROM risk_flags""", "risk_flags")
register("filters_transactions", f"""
SELECT {cnt('is_flagged')} AS flagged_transactions, {cnt(f'txn_ts >= {AS_OF} - INTERVAL 7 DAYS')} AS this_week,
  {cnt('high_risk_country')} AS high_risk_country_transactions,
  {cnt("fraud_pattern = 'STRUCTURING'")} AS structuring_pattern
FROM transactions""", "transactions")
register("filters_accounts", f"""
SELECT {cnt('npa_flag')} AS npa_accounts, {cnt("status = 'ACTIVE'")} AS active_accounts,
  {cnt("status = 'FROZEN'")} AS frozen_accounts, {cnt('utilisation_pct > 90')} AS over_utilised_accounts
FROM accounts""", "accounts")
register("filters_customers", f"""
SELECT {cnt("risk_rating = 'HIGH'")} AS high_risk_customers, {cnt('pep_flag')} AS pep_customers,
  {cnt('sanction_flag')} AS sanctioned_customers, {cnt("kyc_status = 'EXPIRED'")} AS expired_kyc
FROM customers""", "customers")
register("filters_credit_exposures", f"""
SELECT {cnt('watch_list_flag')} AS watch_list_exposures, {cnt("sector = 'REAL_ESTATE'")} AS real_estate_sector,
  {cnt("collateral_type = 'UNSECURED'")} AS unsecured_exposures
FROM exposures""", "exposures")
register("filters_liquidity_positions", f"""
SELECT {cnt('lcr_breach')} AS lcr_breach_days, {cnt("tenor_bucket IN ('0_7D', '8_30D')")} AS short_term_buckets,
  {cnt("stress_scenario = 'BASE'")} AS base_scenario
FROM positions""", "positions")

register("facts_risk_flags", f"""
SELECT {davg('flag_score', 2, 8)} AS avg_flag_score, {davg('threshold_value', 4, 8)} AS avg_threshold_value,
  {davg('threshold_limit', 4, 8)} AS avg_threshold_limit
FROM risk_flags""", "risk_flags")
register("facts_transactions", f"""
SELECT {dsum('amount')} AS sum_amount, {davg('flag_score', 2, 8)} AS avg_flag_score
FROM transactions""", "transactions")
register("facts_accounts", f"""
SELECT {dsum('balance')} AS sum_balance, {dsum('credit_limit')} AS sum_credit_limit,
  {davg('utilisation_pct', 2, 8)} AS avg_utilisation_pct
FROM accounts""", "accounts")
register("facts_credit_exposures", f"""
SELECT {dsum('outstanding')} AS sum_outstanding, {davg('pd_score', 4, 8)} AS avg_pd_score,
  {davg('lgd', 4, 8)} AS avg_lgd, {dsum('ead')} AS sum_ead, {dsum('expected_loss')} AS sum_expected_loss,
  {dsum('rwa')} AS sum_rwa, {davg('utilisation_pct', 2, 8)} AS avg_utilisation_pct
FROM exposures""", "exposures")
register("facts_liquidity_positions", f"""
SELECT {davg('lcr_ratio', 4, 8)} AS avg_lcr_ratio, {davg('nsfr_ratio', 4, 8)} AS avg_nsfr_ratio,
  {dsum('inflow')} AS sum_inflow, {dsum('outflow')} AS sum_outflow, {dsum('net_position')} AS sum_net_position,
  {dsum('lcr_numerator')} AS sum_hqla_total
FROM positions""", "positions")

register("metric_query_multi", f"""
SELECT c.segment, a.account_type, {TXN_METRICS.replace('is_flagged', 't.is_flagged').replace('txn_id', 't.txn_id')}
FROM transactions t LEFT JOIN accounts a ON a.account_id = t.account_id
LEFT JOIN customers c ON c.customer_id = a.customer_id
GROUP BY c.segment, a.account_type""", "transactions", "accounts", "customers")

register("metric_query_two_facts", f"""
SELECT COALESCE(f.segment, e.segment) AS segment, f.open_flag_count, f.critical_flag_count,
  e.watch_list_count, e.total_rwa
FROM (SELECT c.segment, {FLAG_METRICS} FROM risk_flags r LEFT JOIN customers c ON c.customer_id = r.customer_id
      GROUP BY c.segment) f
FULL OUTER JOIN (SELECT c.segment, {CREDIT_METRICS2} FROM exposures x
      LEFT JOIN customers c ON c.customer_id = x.customer_id GROUP BY c.segment) e
  ON f.segment IS NOT DISTINCT FROM e.segment""", "risk_flags", "exposures", "customers")

register("metric_query_filter_joined", f"""
SELECT a.account_type, {cnt('t.is_flagged')} AS total_flagged_transactions,
  {dsum('CASE WHEN t.is_flagged THEN t.amount ELSE 0 END')} AS total_flagged_amount
FROM transactions t LEFT JOIN accounts a ON a.account_id = t.account_id
LEFT JOIN customers c ON c.customer_id = a.customer_id
WHERE c.risk_rating = 'HIGH' AND t.txn_ts >= {AS_OF} - INTERVAL 7 DAYS
GROUP BY a.account_type""", "transactions", "accounts", "customers")

register("metric_query_facts", """
SELECT c.segment, CAST(SUM(t.amount) AS DECIMAL(18,2)) AS sum_amount,
  CAST(AVG(t.flag_score) AS DECIMAL(18,8)) AS avg_flag_score
FROM transactions t LEFT JOIN accounts a ON a.account_id = t.account_id
LEFT JOIN customers c ON c.customer_id = a.customer_id GROUP BY c.segment""", "transactions", "accounts", "customers")

register("metric_query_two_facts_filtered", f"""
SELECT COALESCE(f.segment, e.segment) AS segment, f.open_flag_count, e.total_rwa
FROM (SELECT c.segment, {FLAG_METRICS} FROM risk_flags r JOIN customers c ON c.customer_id = r.customer_id
      WHERE c.risk_rating = 'HIGH' GROUP BY c.segment) f
FULL OUTER JOIN (SELECT c.segment, {CREDIT_METRICS2} FROM exposures x
      JOIN customers c ON c.customer_id = x.customer_id WHERE c.risk_rating = 'HIGH' GROUP BY c.segment) e
  ON f.segment IS NOT DISTINCT FROM e.segment""", "risk_flags", "exposures", "customers")

register("metric_query_time", f"""
SELECT date_trunc('day', txn_ts) AS txn_date, channel, {cnt('is_flagged')} AS total_flagged_transactions,
  {dsum('CASE WHEN is_flagged THEN amount ELSE 0 END')} AS total_flagged_amount
FROM transactions WHERE txn_ts >= {AS_OF} - INTERVAL 7 DAYS
GROUP BY 1, 2""", "transactions")

register("metric_query_ranked", f"""
SELECT sector, internal_rating, {dsum('rwa')} AS total_rwa, {cnt('watch_list_flag')} AS watch_list_count
FROM exposures WHERE watch_list_flag
GROUP BY sector, internal_rating ORDER BY total_rwa DESC, sector, internal_rating LIMIT 10""", "exposures")


# ---- dashboard / board queries ---------------------------------------------
from ledgerguard.functions.rules import RULE_CATALOG  # noqa: E402

RATIONALE = "CASE flag_type " + " ".join(
    "WHEN '{}' THEN '{}'".format(t, txt.replace("'", "''")) for t, _, _, txt in RULE_CATALOG) + " END"
NF = "flag_status NOT IN ('ACTIONED', 'DISMISSED')"
OPEN_FRAUD = f"flag_domain = 'FRAUD' AND {NF}"


def r1avg(expr: str, in_scale: int, times: str = "") -> str:
    return f"CAST(ROUND({avg_dec(expr, in_scale + 4)}{times}, 1) AS DECIMAL(18,1))"


register("q9", f"""
SELECT COUNT(*) AS fraud_flag_count, {cnt("severity = 'CRITICAL'")} AS critical_count,
  {r1avg('flag_score', 2)} AS avg_score
FROM risk_flags WHERE {OPEN_FRAUD}""", "risk_flags")

register("q10", """
SELECT CAST(ROUND(lcr_ratio * 100, 1) AS DECIMAL(18,1)) AS lcr_pct, lcr_breach, position_date,
  CASE WHEN lcr_breach THEN 'BREACH' WHEN ROUND(lcr_ratio * 100, 1) < 110 THEN 'AMBER' ELSE 'GREEN' END AS rag_state
FROM positions WHERE tenor_bucket = '0_7D' AND stress_scenario = 'BASE'
ORDER BY position_date DESC LIMIT 1""", "positions")

register("q11", f"""
SELECT COUNT(*) AS watch_list_count, CAST(ROUND(SUM(rwa) * 0.000001, 1) AS DECIMAL(18,1)) AS rwa_millions,
  {r1avg('pd_score', 4, ' * 100')} AS avg_pd_pct
FROM exposures WHERE watch_list_flag""", "exposures")

register("q12", f"""
SELECT COUNT(*) AS open_cases, {cnt('sla_breach')} AS sla_breaches
FROM case_escalations WHERE status NOT IN ('RESOLVED', 'CLOSED')""", "case_escalations")

register("q13", f"""
SELECT flag_id, flag_domain, flag_type, severity, account_id, customer_id,
  CAST(ROUND(flag_score, 1) AS DECIMAL(18,1)) AS score, left({RATIONALE}, 110) AS rationale, flag_status
FROM risk_flags WHERE {NF}
ORDER BY score DESC, flag_id LIMIT 300""", "risk_flags")

register("q13_filtered", f"""
SELECT flag_id, flag_domain, flag_type, severity, flag_score FROM risk_flags
WHERE {NF} AND severity IN ('CRITICAL', 'HIGH') AND flag_score >= 65
ORDER BY flag_score DESC, flag_id LIMIT 300""", "risk_flags")

register("q13_limit_first", f"""
SELECT flag_id, flag_domain, flag_type, severity, flag_score FROM (
  SELECT * FROM risk_flags WHERE {NF} ORDER BY flag_score DESC, flag_id LIMIT 300) t
WHERE severity IN ('CRITICAL', 'HIGH') AND flag_score >= 65""", "risk_flags")

LCR_SERIES = (f"FROM positions WHERE tenor_bucket = '0_7D' AND stress_scenario = 'BASE' "
              f"AND position_date >= CAST({AS_OF} AS DATE) - 30")

register("q14", f"""
SELECT position_date, CAST(ROUND(lcr_ratio * 100, 1) AS DECIMAL(18,1)) AS lcr_pct,
  CAST(100.0 AS DECIMAL(18,1)) AS floor_pct, coalesce(ROUND(lcr_ratio * 100, 1) < 100, false) AS below_floor
{LCR_SERIES}""", "positions")

register("q14_summary", f"""
SELECT CAST(MIN(pct) AS DECIMAL(18,1)) AS min_pct, CAST(MAX(pct) AS DECIMAL(18,1)) AS max_pct,
  {r1avg('pct', 1)} AS avg_pct, COUNT(pct) AS n_days,
  {cnt('pct < 100')} AS breach_days,
  coalesce(array_to_string(list_slice(list(CAST(position_date AS VARCHAR) || '=' || CAST(pct AS VARCHAR)
      ORDER BY position_date) FILTER (WHERE pct < 100), 1, 8), '; '), '') AS breach_list
FROM (SELECT position_date, CAST(ROUND(lcr_ratio * 100, 1) AS DECIMAL(18,1)) AS pct {LCR_SERIES}) s""", "positions")

AUDIT_COLS = ("log_id, actor_user, actor_role, action_type, object_type, object_id, change_summary, "
              "CAST(event_ts AS VARCHAR) AS et")
register("q15", f"SELECT {AUDIT_COLS} FROM audit_log ORDER BY et DESC, log_id DESC LIMIT 150", "audit_log")
register("q15_search", f"""
SELECT {AUDIT_COLS} FROM audit_log
WHERE action_type IN ('FLAG_ACCOUNT', 'FILE_SAR') AND coalesce(contains(lower(change_summary), 'frozen'), false)
ORDER BY et DESC, log_id DESC LIMIT 150""", "audit_log")

register("q16", """
SELECT action_type, object_type, object_id, left(change_summary, 70) AS cs, left(CAST(event_ts AS VARCHAR), 16) AS ts
FROM audit_log ORDER BY event_ts DESC, log_id DESC LIMIT 4""", "audit_log")

register("q17", f"""
SELECT (SELECT COUNT(*) FROM transactions WHERE is_flagged) AS txn_flagged,
  (SELECT COUNT(*) FROM risk_flags WHERE {NF}) AS open_flags,
  (SELECT COUNT(*) FROM regulatory_filings) AS filings,
  (SELECT COUNT(*) FROM case_escalations WHERE status NOT IN ('RESOLVED', 'CLOSED')) AS cases,
  (SELECT COUNT(*) FROM audit_log) AS audits""",
         "transactions", "risk_flags", "regulatory_filings", "case_escalations", "audit_log")

register("q18", f"""
SELECT flag_domain, {cnt("severity = 'CRITICAL'")} AS CRITICAL, {cnt("severity = 'HIGH'")} AS HIGH,
  {cnt("severity = 'MEDIUM'")} AS MEDIUM, {cnt("severity = 'LOW'")} AS LOW
FROM risk_flags GROUP BY flag_domain""", "risk_flags")

register("q19", """
SELECT actor_role, action_type, COUNT(*) AS n FROM audit_log GROUP BY 1, 2
ORDER BY n DESC, actor_role, action_type LIMIT 8""", "audit_log")

Q20 = """SELECT sector, internal_rating, COUNT(*) AS n, CAST(ROUND(SUM(rwa) * 0.000001, 1) AS DECIMAL(18,1)) AS rwa_m
FROM exposures WHERE watch_list_flag GROUP BY 1, 2 ORDER BY rwa_m DESC, sector, internal_rating LIMIT 8"""
register("q20", Q20, "exposures")

register("q21", f"""
SELECT r.flag_id, r.flag_type, r.account_id, r.customer_id,
  CAST(ROUND(r.flag_score, 0) AS DECIMAL(18,0)) AS sc, left({RATIONALE.replace('flag_type', 'r.flag_type')}, 90) AS reg,
  coalesce(c.full_name, 'Unknown') AS nm, coalesce(CAST(c.pep_flag AS VARCHAR), 'false') AS pep,
  a.status AS acct_status
FROM (SELECT * FROM risk_flags WHERE {OPEN_FRAUD} ORDER BY flag_score DESC, flag_id LIMIT 10) r
LEFT JOIN customers c ON c.customer_id = r.customer_id
LEFT JOIN accounts a ON a.account_id = r.account_id""", "risk_flags", "customers", "accounts")

register("q22", f"""
SELECT (SELECT COUNT(*) FROM risk_flags WHERE {OPEN_FRAUD}) AS fraud_count,
  (SELECT COUNT(*) FROM exposures WHERE watch_list_flag) AS watch_list_count,
  (SELECT CAST(ROUND(SUM(rwa) * 0.000001, 0) AS DECIMAL(18,0)) FROM exposures WHERE watch_list_flag)
    AS watch_rwa_millions,
  (SELECT COUNT(DISTINCT position_date) FROM positions WHERE lcr_breach AND tenor_bucket = '0_7D')
    AS lcr_breach_days,
  (SELECT COUNT(*) FROM audit_log WHERE action_type = 'FILE_SAR') AS sar_count""",
         "risk_flags", "exposures", "positions", "audit_log")

register("q23", f"""
SELECT (SELECT COUNT(*) FROM risk_flags WHERE {OPEN_FRAUD}) AS open_fraud_flags,
  (SELECT COUNT(*) FROM risk_flags WHERE {NF} AND severity = 'CRITICAL') AS critical_flags,
  (SELECT CAST(CAST(ROUND(lcr_ratio * 100, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%'
          || CASE WHEN lcr_breach THEN ' BREACH' ELSE ' OK' END
   FROM positions WHERE tenor_bucket = '0_7D' AND stress_scenario = 'BASE'
   ORDER BY position_date DESC LIMIT 1) AS lcr_state,
  (SELECT COUNT(*) FROM exposures WHERE watch_list_flag) AS watch_list_count,
  (SELECT CAST(ROUND(SUM(rwa) * 0.000001, 0) AS DECIMAL(18,0)) FROM exposures WHERE watch_list_flag)
    AS watch_rwa_millions,
  (SELECT COUNT(*) FROM case_escalations WHERE status NOT IN ('RESOLVED', 'CLOSED')) AS open_cases,
  (SELECT COUNT(*) FROM audit_log WHERE action_type = 'FILE_SAR') AS sars_filed,
  (SELECT string_agg(actor_role || ':' || action_type || '=' || CAST(n AS VARCHAR), ' | '
                     ORDER BY n DESC, actor_role, action_type)
   FROM (SELECT actor_role, action_type, COUNT(*) AS n FROM audit_log GROUP BY 1, 2
         ORDER BY n DESC, actor_role, action_type LIMIT 8) x) AS actions_by_role,
  (SELECT string_agg(sector || '/' || internal_rating || ': ' || CAST(n AS VARCHAR) || ' facilities, $'
                     || CAST(rwa_m AS VARCHAR) || 'M RWA', ' | ' ORDER BY rwa_m DESC, sector, internal_rating)
   FROM ({Q20}) y) AS rwa_by_sector,
  (SELECT string_agg(title || ': ' || left(content, 200), ' | ' ORDER BY doc_id)
   FROM (SELECT * FROM policy_docs ORDER BY doc_id LIMIT 5) d) AS policy_snippets""",
         "risk_flags", "positions", "exposures", "case_escalations", "audit_log", "policy_docs")

register("q24", f"""
SELECT fraud_pattern, COUNT(*) AS cnt, {r1avg('flag_score', 2)} AS avg_score
FROM transactions WHERE is_flagged GROUP BY fraud_pattern""", "transactions")

register("q25", """
SELECT flag_domain, severity, COUNT(*) AS cnt FROM risk_flags WHERE flag_status = 'OPEN'
GROUP BY flag_domain, severity""", "risk_flags")

register("q26", f"""
SELECT flag_domain, COUNT(*) AS flag_count, {r1avg('flag_score', 2)} AS avg_score
FROM risk_flags GROUP BY flag_domain""", "risk_flags")

register("q27", f"""
SELECT COUNT(DISTINCT position_date) AS total_days, {cnt('lcr_breach')} AS breach_positions,
  {r1avg('lcr_ratio', 4, ' * 100')} AS avg_lcr_pct,
  CAST(ROUND(MIN(lcr_ratio) * 100, 1) AS DECIMAL(18,1)) AS min_lcr_pct
FROM positions WHERE tenor_bucket = '0_7D'""", "positions")

register("q28", """
SELECT '1_SIGNAL' AS step, 'RISK_FLAGS' AS source, CAST(COUNT(*) AS VARCHAR) || ' critical flags' AS detail
FROM risk_flags WHERE severity = 'CRITICAL'
UNION ALL SELECT '2_SAR_COUNT', 'REGULATORY_FILINGS', CAST(COUNT(*) AS VARCHAR) || ' SAR drafts on file'
FROM regulatory_filings WHERE filing_type = 'SAR'
UNION ALL SELECT '3_FROZEN', 'ACCOUNTS', CAST(COUNT(*) AS VARCHAR) || ' accounts currently FROZEN'
FROM accounts WHERE status = 'FROZEN'
UNION ALL SELECT '4_ESCALATED', 'CASE_ESCALATIONS', CAST(COUNT(*) AS VARCHAR) || ' cases ESCALATED'
FROM case_escalations WHERE status = 'ESCALATED'
UNION ALL SELECT '5_AUDIT', 'AUDIT_LOG', CAST(COUNT(*) AS VARCHAR) || ' immutable audit entries' FROM audit_log
ORDER BY step""", "risk_flags", "regulatory_filings", "accounts", "case_escalations", "audit_log")

register("q29", """
SELECT account_id, arg_max(case_id, struct_pack(created_at, case_id)) AS case_id,
  arg_max(case_type, struct_pack(created_at, case_id)) AS case_type,
  arg_max(severity, struct_pack(created_at, case_id)) AS severity,
  arg_max(status, struct_pack(created_at, case_id)) AS status, COUNT(*) AS open_cases
FROM case_escalations WHERE status NOT IN ('RESOLVED', 'CLOSED') GROUP BY account_id""", "case_escalations")

register("distinct_rationales", f"""
SELECT DISTINCT flag_type, {RATIONALE} AS threshold_rationale FROM risk_flags WHERE flag_domain = 'FRAUD'
ORDER BY flag_type""", "risk_flags")


# ---- governance ----------------------------------------------------------------
from ledgerguard.functions import constants as K  # noqa: E402
from ledgerguard.operators import governance as G  # noqa: E402
from ledgerguard.operators import quality as DQ  # noqa: E402
from oracle.ctes import _add as add_cte  # noqa: E402


def mask_sql(kind: str, col: str, role: str) -> str:
    if kind == "national_id":
        return col if role in G.FULL_PII_ROLES else f"'XXX-XX-' || right({col}, 4)"
    if kind == "full_name":
        return col if role in G.FULL_PII_ROLES else f"split_part({col}, ' ', 1) || ' ***'"
    if role in G.FULL_ACCOUNT_ROLES:
        return col
    if role in G.PARTIAL_ACCOUNT_ROLES:
        return f"'XXXX-' || right({col}, 4)"
    return f"'XXXX-XXXX-' || right({col}, 4)"


for _r in K.ALL_ROLES:
    register(f"masked_customers_{_r.lower()}", f"""
SELECT customer_id, {mask_sql('full_name', 'full_name', _r)} AS full_name,
  {mask_sql('national_id', 'national_id', _r)} AS national_id, segment FROM customers""", "customers")
    register(f"masked_accounts_{_r.lower()}", f"""
SELECT account_id, {mask_sql('account_number', 'account_number', _r)} AS account_number, status
FROM accounts""", "accounts")

register("filings_rowfilter_manager", f"""
SELECT filing_id, assigned_to, filing_type FROM regulatory_filings
WHERE assigned_to = 'reviewer@partner.example' OR assigned_to LIKE '%{K.BANK_DOMAIN}'""", "regulatory_filings")
register("filings_rowfilter_analyst", """
SELECT filing_id, assigned_to, filing_type FROM regulatory_filings WHERE false""", "regulatory_filings")
register("filings_rowfilter_auditor", """
SELECT filing_id, assigned_to, filing_type FROM regulatory_filings""", "regulatory_filings")

_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in K.ROLE_EDGES)
_EXEC = ", ".join(f"('{r}', '{o}')" for r, p, o in G.GRANTS if p == "EXECUTE")
register("audit_authorization", f"""
SELECT a.actor_role, a.action_type, coalesce(e.authorized, false) AS authorized, COUNT(*) AS n
FROM audit_log a
LEFT JOIN (
  WITH RECURSIVE edges(child, parent) AS (VALUES {_EDGES}),
  closure(role, inherited) AS (
    SELECT parent, child FROM edges
    UNION SELECT c.role, e.child FROM closure c JOIN edges e ON e.parent = c.inherited),
  allr(role, inherited) AS (SELECT * FROM closure UNION SELECT child, child FROM edges
                            UNION SELECT parent, parent FROM edges),
  grants(role, object) AS (VALUES {_EXEC})
  SELECT DISTINCT r.role AS actor_role, g.object AS action_type, true AS authorized
  FROM allr r JOIN grants g ON g.role = r.inherited) e
ON e.actor_role = a.actor_role AND e.action_type = a.action_type
GROUP BY 1, 2, 3""", "audit_log")

# ---- data quality -------------------------------------------------------------------
_DQ_SOURCES = {"customers": "customers", "accounts": "accounts", "transactions": "transactions",
               "credit_exposures": "exposures", "liquidity_positions": "positions",
               "regulatory_filings": "regulatory_filings", "case_escalations": "case_escalations",
               "audit_log": "audit_log", "risk_flags": "risk_flags", "policy_docs": "policy_docs"}
register("dq_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS n, CAST({DQ.EXPECTED_MIN_ROWS[t]} AS BIGINT) AS min_expected, "
    f"COUNT(*) >= {DQ.EXPECTED_MIN_ROWS[t]} AS meets_minimum FROM {v}" for t, v in _DQ_SOURCES.items()),
    *_DQ_SOURCES.values())

_key_parts = []
for _t, _v in _DQ_SOURCES.items():
    for _kind, _keys in (("primary", DQ.PRIMARY_KEYS.get(_t)), ("unique", DQ.UNIQUE_KEYS.get(_t))):
        if _keys:
            _k = ", ".join(_keys)
            _key_parts.append(
                f"SELECT '{_t}' AS table_name, '{_kind}' AS key_kind, '{','.join(_keys)}' AS key_columns, "
                f"COUNT(*) AS duplicate_keys, CAST(coalesce(SUM(n), 0) AS BIGINT) AS duplicate_rows "
                f"FROM (SELECT {_k}, COUNT(*) AS n FROM {_v} GROUP BY {_k} HAVING COUNT(*) > 1) d")
register("dq_keys", " UNION ALL ".join(_key_parts), *_DQ_SOURCES.values())

register("dq_orphans", " UNION ALL ".join(
    f"SELECT '{ch}.{cc}' AS child, '{pa}.{pc}' AS parent, COUNT(*) AS orphans FROM {_DQ_SOURCES[ch]} x "
    f"WHERE x.{cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_DQ_SOURCES[pa]} y WHERE y.{pc} = x.{cc})"
    for ch, cc, pa, pc in DQ.FOREIGN_KEYS), *_DQ_SOURCES.values())


def _lst(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


_DOMAIN_SQL = {
    "customers": {"segment_domain": f"segment IN ({_lst(K.SEGMENTS)})",
                  "kyc_domain": f"kyc_status IN ({_lst(K.KYC_STATUSES)})",
                  "rating_domain": f"risk_rating IN ({_lst(K.RISK_RATINGS)})",
                  "national_id_not_null": "national_id IS NOT NULL",
                  "national_id_len": "length(national_id) <= 20", "full_name_len": "length(full_name) <= 120"},
    "accounts": {"type_domain": f"account_type IN ({_lst(K.ACCOUNT_TYPES)})",
                 "status_domain": f"status IN ({_lst(K.ACCOUNT_STATUSES)})", "currency_len": "length(currency) = 3",
                 "npa_consistent": "npa_flag = (status = 'NPA')"},
    "transactions": {"type_domain": "txn_type IN ('DEBIT', 'CREDIT')",
                     "channel_domain": f"channel IN ({_lst(K.CHANNELS)})", "amount_not_null": "amount IS NOT NULL",
                     "ts_not_null": "txn_ts IS NOT NULL"},
    "credit_exposures": {"pd_range": "pd_score BETWEEN 0 AND 1", "lgd_range": "lgd BETWEEN 0 AND 1",
                         "rating_domain": f"internal_rating IN ({_lst(K.INTERNAL_RATINGS)})",
                         "sector_domain": f"sector IN ({_lst(K.SECTORS)})"},
    "liquidity_positions": {"bucket_domain": f"tenor_bucket IN ({_lst(K.TENOR_BUCKETS)})",
                            "inflow_non_negative": "inflow >= 0", "outflow_non_negative": "outflow >= 0"},
    "case_escalations": {"severity_domain": f"severity IN ({_lst(K.CASE_SEVERITIES)})",
                         "status_domain": f"status IN ({_lst(K.CASE_STATUSES)})",
                         "type_domain": f"case_type IN ({_lst(K.CASE_TYPES)})"},
}
register("dq_domains", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS check_name, "
    f"CAST(SUM(CASE WHEN coalesce({p}, false) THEN 0 ELSE 1 END) AS BIGINT) AS violations FROM {_DQ_SOURCES[t]}"
    for t, checks in _DOMAIN_SQL.items() for k, p in checks.items()), *_DQ_SOURCES.values())

_mask_parts = []
for _table, _cols in DQ.SENSITIVE.items():
    for _role in K.ALL_ROLES:
        for _col in _cols:
            _mask_parts.append(
                f"SELECT '{_role}' AS role, '{_table}' AS table_name, '{_col}' AS column_name, "
                f"CAST(SUM(CASE WHEN {mask_sql(_col, _col, _role)} = {_col} THEN 1 ELSE 0 END) AS BIGINT) "
                f"AS unmasked_values, COUNT(*) AS visible_rows FROM {_table}")
register("dq_masking", " UNION ALL ".join(_mask_parts), "customers", "accounts")

# ---- actions ---------------------------------------------------------------------
OFFICER_USER = "compliance.officer" + K.BANK_DOMAIN
COMMITTEE = "risk.committee" + K.BANK_DOMAIN
add_cte("flags_full", f"""
SELECT r.*, {RATIONALE} AS threshold_rationale FROM risk_flags r""", ["risk_flags"])
add_cte("sar_requests", """
SELECT flag_id AS request_id, flag_id, CASE WHEN flag_domain = 'FRAUD' THEN 'auto-filed' END AS notes
FROM risk_flags WHERE severity = 'CRITICAL'
UNION ALL
SELECT flag_id + 10000000000000000, flag_id, NULL FROM risk_flags WHERE flag_type = 'CROSS_BORDER'""",
        ["risk_flags"])
add_cte("sar_eval", """
SELECT q.request_id, q.flag_id, q.notes, f.flag_type, f.flag_status, f.customer_id, f.account_id,
  f.threshold_rationale, f.flag_score,
  CASE WHEN q.request_id <> w.first_id THEN 'Duplicate request in batch'
       WHEN f.flag_id IS NULL OR f.flag_status IN ('ACTIONED', 'DISMISSED') THEN 'Flag not found or already actioned'
       WHEN f.customer_id IS NULL THEN 'no_customer' END AS error
FROM sar_requests q
JOIN (SELECT flag_id, MIN(request_id) AS first_id FROM sar_requests GROUP BY flag_id) w ON w.flag_id = q.flag_id
LEFT JOIN flags_full f ON f.flag_id = q.flag_id""", ["sar_requests", "flags_full"])
add_cte("sar_ok", """
SELECT *, (SELECT COALESCE(MAX(filing_id), 0) FROM regulatory_filings)
          + ROW_NUMBER() OVER (ORDER BY request_id) AS filing_id
FROM sar_eval WHERE error IS NULL""", ["sar_eval", "regulatory_filings"])

register("sar_batch", """
SELECT request_id, flag_id, 'ok' AS status, filing_id, 'SAR draft created.' AS message, CAST(NULL AS VARCHAR) AS error
FROM sar_ok
UNION ALL
SELECT request_id, flag_id, 'error', NULL, NULL, error FROM sar_eval WHERE error IS NOT NULL""",
         "sar_ok", "sar_eval")
register("sar_responses", """
SELECT request_id, '{"filing_id":' || CAST(filing_id AS VARCHAR) || ',"status":"DRAFT","flag_id":' || CAST(flag_id AS VARCHAR)
  || ',"message":"SAR draft created."}' AS response FROM sar_ok
UNION ALL SELECT request_id, '{"error":"' || error || '"}' FROM sar_eval WHERE error IS NOT NULL""", "sar_ok", "sar_eval")
register("sar_filings", f"""
SELECT filing_id, customer_id, account_id, 'DRAFT' AS filing_status,
  'SAR drafted from risk flag ' || CAST(flag_id AS VARCHAR) || '. Flag: ' || flag_type || '. Regulatory basis: '
    || coalesce(threshold_rationale, '') || CASE WHEN notes IS NOT NULL THEN '. Notes: ' || notes ELSE '' END
    AS narrative,
  CAST(coalesce(flag_score, 0) AS DECIMAL(5,2)) AS risk_score, 'SAR-FLAG-' || CAST(flag_id AS VARCHAR)
    AS reference_case_id, '{OFFICER_USER}' AS filed_by
FROM sar_ok""", "sar_ok")
register("sar_flag_state", """
SELECT f.flag_domain, CASE WHEN o.flag_id IS NOT NULL THEN 'ACTIONED' ELSE f.flag_status END AS flag_status,
  CASE WHEN o.flag_id IS NOT NULL THEN 'SAR_FILED' END AS action_taken, COUNT(*) AS n
FROM risk_flags f LEFT JOIN sar_ok o ON o.flag_id = f.flag_id GROUP BY 1, 2, 3""", "risk_flags", "sar_ok")
register("sar_audit_rows", f"""
SELECT (SELECT COALESCE(MAX(log_id), 0) FROM audit_log) + ROW_NUMBER() OVER (ORDER BY request_id) AS log_id,
  '{K.ROLE_COMPLIANCE}' AS actor_role, 'FILE_SAR' AS action_type, 'FILING' AS object_type,
  CAST(filing_id AS VARCHAR) AS object_id,
  '{{"filing_id":' || CAST(filing_id AS VARCHAR) || ',"flag_id":' || CAST(flag_id AS VARCHAR) || '}}' AS after_state,
  'SAR filed from flag_id=' || CAST(flag_id AS VARCHAR) || ' filing_id=' || CAST(filing_id AS VARCHAR)
    AS change_summary
FROM sar_ok""", "sar_ok", "audit_log")

add_cte("freeze_ok", """
SELECT q.request_id, q.account_id, q.request_id AS linked_flag_id, a.customer_id, a.status AS before_status,
  (SELECT COALESCE(MAX(case_id), 0) FROM case_escalations) + ROW_NUMBER() OVER (ORDER BY q.request_id) AS case_id
FROM (SELECT account_id, MIN(flag_id) AS request_id FROM risk_flags
      WHERE flag_domain = 'FRAUD' AND flag_status = 'CONFIRMED_FRAUD' GROUP BY account_id) q
JOIN accounts a ON a.account_id = q.account_id""", ["risk_flags", "accounts", "case_escalations"])
register("freeze_batch", """
SELECT request_id, account_id, 'ok' AS status, case_id, 'FROZEN' AS new_status, 'Account flagged and case opened.' AS message,
  CAST(NULL AS VARCHAR) AS error FROM freeze_ok""", "freeze_ok")
register("freeze_responses", """
SELECT request_id, '{"account_id":' || CAST(account_id AS VARCHAR) || ',"new_status":"FROZEN","case_id":' || CAST(case_id AS VARCHAR)
  || ',"message":"Account flagged and case opened."}' AS response FROM freeze_ok""", "freeze_ok")
register("freeze_cases", """
SELECT case_id, customer_id, account_id, linked_flag_id, CAST(NULL AS BIGINT) AS linked_filing_id, 'OPEN' AS status,
  'Account frozen. Reason: Confirmed fraud under review' AS resolution_notes FROM freeze_ok""", "freeze_ok")

add_cte("esc_eval", """
SELECT case_id AS request_id, case_id, case_type AS notes, status AS before_status,
  CASE WHEN status IN ('RESOLVED', 'CLOSED') THEN 'Case not found or already resolved/closed' END AS error
FROM case_escalations WHERE severity = 'CRITICAL'""", ["case_escalations"])
register("escalate_batch", """
SELECT request_id, case_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN error IS NULL THEN 'ESCALATED' END AS new_status,
  CASE WHEN error IS NULL THEN 'Case escalated.' END AS message, error
FROM esc_eval""", "esc_eval")
register("escalate_responses", f"""
SELECT request_id, CASE WHEN error IS NOT NULL THEN '{{"error":"' || error || '"}}' ELSE '{{"case_id":' || CAST(case_id AS VARCHAR)
  || ',"new_status":"ESCALATED","escalated_to":"{COMMITTEE}","message":"Case escalated."}}' END AS response
FROM esc_eval""", "esc_eval")
register("escalate_state", f"""
SELECT k.case_id, CASE WHEN e.case_id IS NOT NULL THEN 'ESCALATED' ELSE k.status END AS status,
  CASE WHEN e.case_id IS NOT NULL THEN '{COMMITTEE}' ELSE k.escalated_to END AS escalated_to,
  CASE WHEN e.case_id IS NOT NULL THEN coalesce(k.resolution_notes, '') || ' | Escalated by {OFFICER_USER} to '
       || '{COMMITTEE}' || CASE WHEN e.notes IS NOT NULL THEN ': ' || e.notes ELSE '' END
       ELSE k.resolution_notes END AS resolution_notes
FROM case_escalations k LEFT JOIN (SELECT * FROM esc_eval WHERE error IS NULL) e ON e.case_id = k.case_id""",
         "case_escalations", "esc_eval")

register("audit_replay", """
SELECT object_type, object_id,
  arg_max(action_type, struct_pack(event_ts, log_id)) AS last_action,
  arg_max(log_id, struct_pack(event_ts, log_id)) AS last_log_id,
  json_extract_string(arg_max(after_state, struct_pack(event_ts, log_id)), '$.status') AS current_status,
  COUNT(*) AS events
FROM audit_log GROUP BY object_type, object_id""", "audit_log")
ORACLE["audit_replay_tail"] = ORACLE["audit_replay"]
register("backfill_positions", """
SELECT position_date, COUNT(*) AS n, COUNT(lcr_ratio) AS filled, COUNT(*) FILTER (lcr_breach) AS breaches
FROM positions GROUP BY 1""", "positions")

register("action_chain", """
SELECT '1_FILE_SAR' AS step, (SELECT COUNT(*) FROM sar_ok) AS accepted,
  (SELECT COUNT(*) FROM sar_eval WHERE error IS NOT NULL) AS rejected
UNION ALL SELECT '2_FLAG_ACCOUNT', (SELECT COUNT(DISTINCT account_id) FROM sar_ok WHERE account_id IS NOT NULL), 0
UNION ALL SELECT '3_ESCALATE_CASE', (SELECT COUNT(DISTINCT account_id) FROM sar_ok WHERE account_id IS NOT NULL), 0""",
         "sar_ok", "sar_eval")

add_cte("chain_n", """
SELECT (SELECT MAX(log_id) FROM audit_log) AS m, (SELECT COUNT(*) FROM sar_ok) AS s,
  (SELECT COUNT(DISTINCT account_id) FROM sar_ok WHERE account_id IS NOT NULL) AS f""", ["audit_log", "sar_ok"])
register("action_chain_audit", """
SELECT * FROM (
  SELECT 'FILE_SAR' AS action_type, s AS n, m + 1 AS first_id, m + s AS last_id, 0 AS repeated_ids FROM chain_n
  UNION ALL SELECT 'FLAG_ACCOUNT', f, m + s + 1, m + s + f, 0 FROM chain_n
  UNION ALL SELECT 'ESCALATE_CASE', f, m + s + f + 1, m + s + 2 * f, 0 FROM chain_n) WHERE n > 0""", "chain_n")
register("sar_denied", """
SELECT 'error' AS status, 'COMPLIANCE_OFFICER or higher required.' AS error, COUNT(*) AS n FROM sar_eval
HAVING COUNT(*) > 0""", "sar_eval")


# ---- search, conversations, streaming --------------------------------------------
from ledgerguard.plans.search_queries import QUESTIONS  # noqa: E402

add_cte("doc_toks", """
SELECT doc_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) > 0) AS toks
FROM policy_docs""", ["policy_docs"])
add_cte("postings", """
SELECT doc_id, term, COUNT(*) AS tf, doc_len
FROM (SELECT doc_id, unnest(toks) AS term, len(toks) AS doc_len FROM doc_toks) GROUP BY doc_id, term, doc_len""",
        ["doc_toks"])
add_cte("idf", """
SELECT d.term, s.n_docs, s.avg_len,
  ln(1.0::DOUBLE + (CAST(s.n_docs - d.df AS DOUBLE) + 0.5::DOUBLE) / (CAST(d.df AS DOUBLE) + 0.5::DOUBLE)) AS idf
FROM (SELECT term, COUNT(*) AS df FROM postings GROUP BY term) d,
     (SELECT COUNT(*) AS n_docs, AVG(doc_len) AS avg_len FROM (SELECT DISTINCT doc_id, doc_len FROM postings)) s""",
        ["postings"])
_QVALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))
add_cte("questions", f"SELECT * FROM (VALUES {_QVALUES}) q(query_id, text)", [])
add_cte("bench_queries", "SELECT item_id AS query_id, text FROM benchmark", [])


def bm25_sql(queries: str, k: int, doc_filter: str = "") -> str:
    return f"""
SELECT query_id, doc_id, score, rank FROM (
  SELECT query_id, doc_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (
    SELECT q.query_id, p.doc_id,
      ROUND(SUM(i.idf * CAST(p.tf AS DOUBLE) * 2.2::DOUBLE
                / (CAST(p.tf AS DOUBLE) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * CAST(p.doc_len AS DOUBLE)
                                                          / i.avg_len))), 5) AS score
    FROM (SELECT DISTINCT query_id,
                 unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 0)) AS term
          FROM {queries}) q
    JOIN postings p ON p.term = q.term
    JOIN idf i ON i.term = q.term
    {doc_filter}
    GROUP BY q.query_id, p.doc_id) s) r
WHERE rank <= {k}"""


register("index_postings", "SELECT doc_id, term, tf, doc_len FROM postings", "postings")
INDEX_STATS = "SELECT COUNT(DISTINCT doc_id) AS n_docs, COUNT(DISTINCT term) AS n_terms, SUM(tf) AS total_tf FROM postings"
register("index_stats", INDEX_STATS, "postings")
register("bm25_top_k", bm25_sql("questions", 10), "postings", "idf", "questions")
register("bm25_filtered", bm25_sql(
    "questions", 5, "WHERE p.doc_id IN (SELECT doc_id FROM policy_docs WHERE doc_type IN ('REGULATION', "
                    "'INTERNAL_POLICY'))"), "postings", "idf", "questions", "policy_docs")
register("bm25_benchmark", bm25_sql("bench_queries", 3), "postings", "idf", "bench_queries")
register("run_summary", f"""
SELECT q.query_id, COUNT(t.score) AS hits, MAX(t.score) AS best_score, COUNT(t.score) > 0 AS passed
FROM (SELECT DISTINCT query_id FROM questions) q LEFT JOIN ({bm25_sql('questions', 10)}) t ON t.query_id = q.query_id
GROUP BY q.query_id""", "postings", "idf", "questions")

add_cte("asked", """
SELECT query_id, text FROM questions UNION ALL SELECT item_id + 1000, text FROM benchmark UNION ALL SELECT -1, '?!'""", ["questions"])
register("run_totals", """
SELECT COUNT(*) AS asked, COUNT(*) FILTER (hit) AS passed, COUNT(*) FILTER (NOT hit) AS failed, TRUE AS timed FROM (
  SELECT a.query_id, bool_or(p.term IS NOT NULL) AS hit
  FROM (SELECT DISTINCT query_id, unnest(CASE WHEN len(t) = 0 THEN ['?'] ELSE t END) AS term FROM (
          SELECT query_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 0) AS t FROM asked)) a
  LEFT JOIN (SELECT DISTINCT term FROM postings) p ON p.term = a.term GROUP BY 1)""", "asked", "postings")
add_cte("centroids", """
SELECT label AS query_id, list(m ORDER BY i) AS qvec FROM (
  SELECT label, i, AVG(CAST(x AS DOUBLE)) AS m
  FROM (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label""", [])
register("vector_top_k", """
SELECT query_id, vec_id, score, rank FROM (
  SELECT query_id, vec_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT c.query_id, e.vec_id,
               ROUND(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.qvec), 5) AS score
        FROM embeddings e, centroids c) s) r
WHERE rank <= 10""", "centroids")

register("vector_neighbours", """
SELECT query_id, vec_id, score, rank FROM (
  SELECT query_id, vec_id, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, e.vec_id,
               ROUND(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score
        FROM embeddings e, embeddings q) s) r
WHERE rank <= 5""")
register("doc_tags", """
SELECT tag, COUNT(*) AS n_docs FROM (SELECT unnest(tags) AS tag FROM policy_docs) GROUP BY tag""", "policy_docs")
register("doc_snippets", """
SELECT doc_id, title || ': ' || left(content, 200) AS snippet FROM policy_docs ORDER BY doc_id LIMIT 5""",
         "policy_docs")

add_cte("conv_pairs", """
SELECT conv_id, turn AS user_turn, text AS question, next_text AS answer FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role,
            lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_text
  FROM conversations) WHERE role = 'user' AND next_role = 'assistant'""", [])
register("conversation_pairs", "SELECT * FROM conv_pairs", "conv_pairs")
register("conversation_newest", """
SELECT conv_id, user_turn, question, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY user_turn DESC, question, answer) AS nth
FROM conv_pairs""", "conv_pairs")
register("conversation_summary", """
SELECT conv_id, COUNT(*) AS exchanges, MAX(user_turn) AS newest_turn FROM conv_pairs GROUP BY conv_id""",
         "conv_pairs")
register("agent_log_extract", """
SELECT conv_id AS response_id,
  arg_max(text, struct_pack(l := length(text), t := text)) FILTER (WHERE role <> 'system') AS answer,
  coalesce(string_agg(DISTINCT 'context_loader', ',') FILTER (WHERE role = 'system'), '') AS tools
FROM conversations GROUP BY conv_id""")

FRAUD_FLAG_COLS = "flag_id, flag_type, severity, flag_status, customer_id, account_id, txn_id, flag_score"
register("refresh_increment", f"SELECT {FRAUD_FLAG_COLS} FROM fraud_flags", "fraud_flags")
register("refresh_rerun", "SELECT 1 AS run, COUNT(*) AS added FROM fraud_flags UNION ALL SELECT 2, 0",
         "fraud_flags")
register("missed_flags", """
SELECT txn_id, account_id, txn_ts, fraud_pattern FROM transactions
WHERE is_flagged AND txn_ts >= TIMESTAMP '2024-01-30 00:00:00'""", "transactions")
register("stream_velocity", """
SELECT txn_id, account_id, txn_ts, velocity_count FROM (
  SELECT txn_id, account_id, txn_ts, MAX(epoch_us(txn_ts)) OVER () // 1000 * 1000 - 1800000000 AS watermark,
    COUNT(*) OVER (PARTITION BY account_id ORDER BY txn_ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS velocity_count
  FROM tx_raw)
WHERE (epoch_us(txn_ts) // 43200000000 + 1) * 43200000000 <= watermark""", "tx_raw")
register("sliding_velocity", """
SELECT make_timestamp(s) AS window_start, make_timestamp(s + 3600000000) AS window_end, account_id, COUNT(*) AS n
FROM (SELECT account_id, (epoch_us(txn_ts) // 300000000 - k) * 300000000 AS s
      FROM tx_raw, range(12) r(k)) GROUP BY 1, 2, 3""", "tx_raw")
register("flag_rate_15min", """
SELECT make_timestamp((epoch_us(t.txn_ts) // 900000000) * 900000000) AS window_start, f.flag_domain, f.severity,
  COUNT(*) AS n
FROM fraud_flags f JOIN transactions t ON t.txn_id = f.txn_id GROUP BY 1, 2, 3""", "fraud_flags", "transactions")
add_cte("raw_doc_toks", """
SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 0) AS toks
FROM documents""", [])
register("doc_index_stream", """
SELECT COUNT(DISTINCT doc_id) AS n_docs, COUNT(DISTINCT term) AS n_terms, SUM(tf) AS total_tf FROM (
  SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM raw_doc_toks)
  GROUP BY doc_id, term)""", "raw_doc_toks")

register("doc_index_changes", """
SELECT doc_id, version, len(list_distinct(toks)) AS n_terms, len(toks) AS total_tf FROM (
  SELECT doc_id, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS version,
    list_filter(regexp_split_to_array(lower(CASE WHEN lang = 'fr' THEN concat_ws(' ', text, source) ELSE text END), '[^a-z0-9]+'),
                lambda x: length(x) > 0) AS toks
  FROM documents WHERE lang <> 'es' AND text IS NOT NULL)""")


# ---- generators, sinks, scalar families, policy rules ------------------------------
from ledgerguard.functions.rules import RULE_CATALOG as _CAT  # noqa: E402

register("gen_labels", """
SELECT fraud_pattern, COUNT(*) AS n FROM (
  SELECT CASE WHEN (event_id + 1) % 33 < 5 THEN 'VELOCITY' WHEN (event_id + 1) % 50 = 0 THEN 'STRUCTURING'
              WHEN (event_id + 1) % 75 = 0 THEN 'CROSS_BORDER' WHEN (event_id + 1) % 120 = 0 THEN 'ROUND_NUMBER'
         END AS fraud_pattern FROM events) WHERE fraud_pattern IS NOT NULL GROUP BY 1""")
register("generated_transactions", f"""
SELECT fraud_pattern, country_code, COUNT(*) AS n, COUNT(DISTINCT account_id) AS accounts FROM (
  SELECT CASE WHEN rn % 33 < 5 THEN 'VELOCITY' WHEN rn % 50 = 0 THEN 'STRUCTURING'
              WHEN rn % 75 = 0 THEN 'CROSS_BORDER' WHEN rn % 120 = 0 THEN 'ROUND_NUMBER' END AS fraud_pattern,
    CASE WHEN rn % 75 = 0 THEN {K.HIGH_RISK_COUNTRIES!r}[CAST(rn % 10 AS INT) + 1]
         ELSE {K.GENERATED_COUNTRIES!r}[CAST(rn % 10 AS INT) + 1] END AS country_code, rn % 800 + 1 AS account_id
  FROM (SELECT unnest(range(1, (SELECT COUNT(*) FROM events) + 1)) AS rn)) GROUP BY 1, 2""")
_BUCKETS = ", ".join(f"({i + 1}, '{b}')" for i, b in enumerate(K.TENOR_BUCKETS))
register("bucket_index", f"""
SELECT b.idx, b.tenor_bucket, p.positions
FROM (SELECT tenor_bucket, COUNT(*) AS positions FROM positions GROUP BY 1) p
JOIN (VALUES {_BUCKETS}) b(idx, tenor_bucket) ON b.tenor_bucket = p.tenor_bucket""", "positions")
_CATV = ", ".join("('{}', {}, {})".format(t, f"'{f}'" if f else "NULL", "NULL" if lim is None else f"{float(lim)}::DOUBLE")
                  for t, f, lim, _ in _CAT)
from ledgerguard.functions.rules import SHORT_TIPS as _TIPS  # noqa: E402

_TIPV = ", ".join(f"('{t}', '{tip}')" for t, tip in _TIPS.items())
register("flag_tips", f"""
SELECT f.flag_type, t.tip, COUNT(*) AS n, COUNT(*) FILTER (f.flag_status NOT IN ('ACTIONED', 'DISMISSED')) AS unactioned
FROM risk_flags f LEFT JOIN (VALUES {_TIPV}) t(flag_type, tip) ON t.flag_type = f.flag_type GROUP BY 1, 2""", "risk_flags")
register("rule_catalog_usage", f"""
SELECT f.flag_type, f.n, k.fld AS catalog_field, k.lim AS catalog_limit
FROM (SELECT flag_type, COUNT(*) AS n FROM risk_flags GROUP BY 1) f
LEFT JOIN (VALUES {_CATV}) k(flag_type, fld, lim) ON k.flag_type = f.flag_type""", "risk_flags")
register("flags_append", "SELECT flag_domain, flag_status, COUNT(*) AS n FROM risk_flags GROUP BY 1, 2",
         "risk_flags")
register("export_flags_csv", f"""
SELECT flag_id, flag_domain, flag_type, severity, flag_score FROM risk_flags
WHERE {NF} AND severity IN ('CRITICAL', 'HIGH') AND flag_score >= 65
ORDER BY flag_score DESC, flag_id LIMIT 500""", "risk_flags")
register("export_results_json", f"""
SELECT query_id, COUNT(*) AS hits, MAX(score) AS best_score FROM ({bm25_sql('questions', 10)}) t GROUP BY 1""",
         "postings", "idf", "questions")

register("fn_string", """
SELECT customer_id, upper(segment) || '-' || lower(kyc_status) AS tag, chr(CAST(65 + customer_id % 26 AS INTEGER))
  AS letter, lpad(CAST(customer_id AS VARCHAR), 8, '0') AS padded, left(full_name, 8) AS name8,
  right(national_id, 4) AS id4, split_part(email, '@', 2) AS domain FROM customers""", "customers")
register("fn_math", """
SELECT exposure_id, exposure_id % 7 AS m7, ((exposure_id - 100) % 7 + 7) % 7 AS pm7,
  CAST(ROUND(pd_score * 100, 1) AS DECIMAL(10,1)) AS pd_pct, LEAST(pd_score, lgd) AS low,
  CAST(ead - outstanding AS DECIMAL(18,2)) AS headroom FROM exposures""", "exposures")
register("fn_null", """
SELECT account_id, CAST(coalesce(credit_limit, 0) AS DECIMAL(18,2)) AS limit0, nullif(status, 'ACTIVE') AS non_active,
  utilisation_pct IS NULL AS no_util FROM accounts""", "accounts")
register("fn_random", "SELECT COUNT(*) AS n, COUNT(*) AS in_range, COUNT(*) AS uuid_shaped FROM tx_raw", "tx_raw")
register("fn_date", f"""
SELECT txn_id, CAST(txn_ts AS DATE) + 30 AS plus30, txn_ts + INTERVAL 2 HOURS AS plus2h,
  CAST(day(txn_ts) AS BIGINT) AS dom, CAST(hour(txn_ts) AS BIGINT) AS hr,
  date_diff('day', CAST(txn_ts AS DATE), CAST({AS_OF} AS DATE)) AS age_days,
  date_trunc('hour', txn_ts) AS hour_start FROM tx_raw""", "tx_raw")
register("fn_array", """
SELECT case_id, tags[1] AS first_tag, tags[2] AS second_tag, len(tags) AS n_tags,
  list_contains(tags, 'FRAUD') AS is_fraud, array_to_string(evidence_txn_ids, ';') AS evidence
FROM case_escalations""", "case_escalations")
register("fn_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k2,
  CAST(json_object('event_id', event_id, 'event_type', event_type) AS VARCHAR) AS j FROM events""")
register("fn_context", f"""
SELECT actor_user = 'risk.manager{K.BANK_DOMAIN}' AS by_me, actor_role = '{K.ROLE_MANAGER}' AS my_role,
  COUNT(*) AS n FROM audit_log GROUP BY 1, 2""", "audit_log")

register("x1", """
SELECT filing_id, filing_date, due_days, filing_date + due_days AS sar_due_date FROM (
  SELECT *, CASE WHEN outcome = 'UNDER_INVESTIGATION' THEN 90 WHEN customer_id IS NULL THEN 60 ELSE 30 END AS due_days
  FROM regulatory_filings WHERE filing_type = 'SAR')""", "regulatory_filings")
register("x2", """
SELECT txn_id, amount, CAST(txn_ts AS DATE) + 15 AS ctr_due_date FROM transactions
WHERE txn_category = 'CASH' AND amount > 10000""", "transactions")
register("x3", """
SELECT f.filing_id, f.amount_involved, f.amount_involved >= 5000 AS mandatory,
  CASE WHEN f.amount_involved > 100000 THEN 'CHIEF_COMPLIANCE_OFFICER'
       WHEN coalesce(c.pep_flag, false) OR coalesce(c.sanction_flag, false) THEN 'CHIEF_COMPLIANCE_OFFICER'
       WHEN f.amount_involved >= 25000 THEN 'SENIOR_COMPLIANCE_MANAGER' ELSE 'COMPLIANCE_OFFICER' END AS approver
FROM regulatory_filings f LEFT JOIN customers c ON c.customer_id = f.customer_id""",
         "regulatory_filings", "customers")
register("x4", """
SELECT sector, CAST(SUM(outstanding) AS DECIMAL(18,2)) AS outstanding,
  ROUND(CAST(SUM(outstanding) AS DOUBLE) / (SELECT CAST(SUM(outstanding) AS DOUBLE) FROM exposures), 4) AS share,
  ROUND(CAST(SUM(outstanding) AS DOUBLE) / (SELECT CAST(SUM(outstanding) AS DOUBLE) FROM exposures), 4) > 0.25
    AS breach
FROM exposures GROUP BY sector""", "exposures")
register("x5", f"""
SELECT account_id, dpd AS days_past_due,
  CASE WHEN dpd <= 0 THEN 'CURRENT' WHEN dpd <= 30 THEN 'SMA-0' WHEN dpd <= 60 THEN 'SMA-1' WHEN dpd <= 90 THEN 'SMA-2'
       ELSE 'NPA' END AS dpd_class
FROM (SELECT account_id, date_diff('day', last_txn_date, CAST({AS_OF} AS DATE)) AS dpd FROM accounts)""",
         "accounts")
register("x6", f"""
SELECT exposure_id, npa_classification, CAST(rate AS DECIMAL(5,2)) AS provision_rate,
  CAST(ROUND(outstanding * CAST(rate AS DECIMAL(5,2)), 2) AS DECIMAL(18,2)) AS provision
FROM (SELECT e.exposure_id, e.outstanding, a.npa_classification,
        CASE WHEN a.npa_classification = 'SUBSTANDARD' THEN CASE WHEN e.collateral_type <> 'UNSECURED' THEN 0.15
                                                                 ELSE 0.25 END
             WHEN a.npa_classification = 'DOUBTFUL' THEN
               CASE WHEN date_diff('day', a.last_txn_date, CAST({AS_OF} AS DATE)) <= 365 THEN 0.25
                    WHEN date_diff('day', a.last_txn_date, CAST({AS_OF} AS DATE)) <= 1095 THEN 0.40 ELSE 1.0 END
             WHEN a.npa_classification = 'LOSS' THEN 1.0 ELSE 0.0 END AS rate
      FROM exposures e JOIN accounts a ON a.account_id = e.account_id WHERE a.npa_flag)""",
         "exposures", "accounts")
register("x7", """
SELECT position_id, capped_lcr, coalesce(capped_lcr < 0.95, false) AS early_warning FROM (
  SELECT position_id, ROUND(CAST(hqla_level1 + hqla_level2 AS DOUBLE) / NULLIF(greatest(
      CAST(outflow AS DOUBLE) - least(CAST(inflow AS DOUBLE), CAST(outflow AS DOUBLE) * 0.75::DOUBLE),
      CAST(outflow AS DOUBLE) * 0.25::DOUBLE), 0), 4) AS capped_lcr FROM positions)""", "positions")
register("x8", """
SELECT position_id, nsfr_ratio, coalesce(nsfr_ratio < 1.03, false) AS nsfr_warning FROM positions""", "positions")
register("x9", """
SELECT c.txn_id, c.account_id, c.txn_ts, c.amount, COUNT(*) AS debits_48h,
  CAST(SUM(d.amount) AS DECIMAL(18,2)) AS debit_amount_48h
FROM transactions c JOIN transactions d
  ON d.account_id = c.account_id AND d.txn_type = 'DEBIT' AND d.txn_ts >= c.txn_ts
 AND d.txn_ts <= c.txn_ts + INTERVAL 48 HOURS
WHERE c.txn_type = 'CREDIT' AND c.is_structuring GROUP BY 1, 2, 3, 4""", "transactions")
register("x10", """
SELECT txn_id, account_id, txn_ts, n_sub, sub_total FROM (
  SELECT *, CAST(SUM(CASE WHEN txn_type = 'CREDIT' AND amount < 10000 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_sub,
    CAST(SUM(CASE WHEN txn_type = 'CREDIT' AND amount < 10000 THEN amount ELSE 0 END) OVER w AS DECIMAL(18,2))
      AS sub_total
  FROM transactions
  WINDOW w AS (PARTITION BY account_id ORDER BY txn_ts RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW))
WHERE txn_type = 'CREDIT' AND amount < 10000 AND n_sub >= 3""", "transactions")
register("x11", """
SELECT sector, CAST(SUM(rwa) AS DECIMAL(18,2)) AS rwa,
  CAST(ROUND(SUM(rwa) * 0.045, 2) AS DECIMAL(18,2)) AS cet1_need,
  CAST(ROUND(SUM(rwa) * 0.060, 2) AS DECIMAL(18,2)) AS tier1_need,
  CAST(ROUND(SUM(rwa) * 0.080, 2) AS DECIMAL(18,2)) AS total_capital_need FROM exposures GROUP BY sector""",
         "exposures")
register("x12", f"""
SELECT flag_id, flag_score, {AS_OF} + INTERVAL 24 HOURS AS review_due_at FROM risk_flags WHERE flag_score > 75""",
         "risk_flags")
register("x13", f"""
SELECT case_id, status, bd AS business_days_idle, bd > 5 AS sla_breach_calc FROM (
  SELECT case_id, status,
    CASE WHEN CAST({AS_OF} AS DATE) > CAST(updated_at AS DATE)
         THEN len(list_filter(generate_series(CAST(updated_at AS DATE) + 1, CAST({AS_OF} AS DATE), INTERVAL 1 DAY),
                              lambda d: isodow(d) < 6)) ELSE 0 END AS bd
  FROM case_escalations WHERE status NOT IN ('RESOLVED', 'CLOSED'))""", "case_escalations")
register("x14", """
SELECT position_id, position_date,
  position_date + CASE isodow(position_date) WHEN 6 THEN 3 WHEN 7 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 2 END
    AS notify_by
FROM positions WHERE lcr_breach""", "positions")
register("x15", """
SELECT e.exposure_id, CASE WHEN coalesce(a.npa_flag, false) OR e.pd_score > 0.35 THEN 3 WHEN e.pd_score > 0.10 THEN 2
                           ELSE 1 END AS stage
FROM exposures e LEFT JOIN accounts a ON a.account_id = e.account_id""", "exposures", "accounts")

register("dq_conversation_turns", """
SELECT COUNT(*) AS conversations,
  COUNT(*) FILTER (WHERE first_turn <> 0 OR last_turn - first_turn + 1 <> turns OR turns <> distinct_turns) AS with_gaps
FROM (SELECT conv_id, MIN(turn) AS first_turn, MAX(turn) AS last_turn, COUNT(*) AS turns,
             COUNT(DISTINCT turn) AS distinct_turns FROM conversations GROUP BY conv_id)""")

register("action_tallies", """
SELECT count_if(action_type = 'FILE_SAR') AS sars, count_if(action_type = 'FLAG_ACCOUNT') AS freezes,
  count_if(action_type = 'ESCALATE_CASE') AS escalations FROM audit_log""", "audit_log")
register("top_critical_for_action", f"""
SELECT flag_id, flag_domain, flag_type, account_id, customer_id, flag_score FROM risk_flags
WHERE severity = 'CRITICAL' AND {NF} ORDER BY flag_score DESC, flag_id LIMIT 3""", "risk_flags")
register("export_audit_csv", f"SELECT {AUDIT_COLS} FROM audit_log WHERE action_type = 'FLAG_ACCOUNT'", "audit_log")
