"""Fraud detection over transactions (O-D1..O-D9).

The documented rules are computed from the data (the reference only injected
labels): velocity by a trailing time window, structuring by amount band,
cross-border by jurisdiction list, round numbers by modulus.  Every detector
is a column-adding ``DataFrame -> DataFrame`` step; only velocity shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K
from ledgerguard.functions.rules import fraud_severity, rationale
from ledgerguard.operators.key_registry import KeyRegistry
from ledgerguard.operators.timewin import forward_max, trailing_count
from ledgerguard.session import ts_lit
from ledgerguard.sources.schemas import RISK_FLAGS_SCHEMA, conform

FRAUD_ID_BASE = 1_000_000_000_000_000
ID_SPAN = 1_000_000_000_000_000
TEXT_ID_BASE = 4_000_000_000_000_000


def detect_velocity(txns: DataFrame, n: int = K.VELOCITY_MIN_TXNS, window: str = K.VELOCITY_WINDOW,
                    account_col: str = "account_id", ts_col: str = "txn_ts",
                    mark_burst: bool = False, dense: DataFrame | None = None) -> DataFrame:
    """O-D1 / O-W3: ``velocity_count`` = txns of the account in ``[ts - window, ts]``;
    ``is_velocity`` = count >= n.  With ``mark_burst`` every member of such a window is
    flagged (``is_velocity_burst``), also the ones before the n-th txn.  ``dense``: the
    accounts' density (timewin.density), computed once and shared by all windows over them."""
    out = trailing_count(txns, [account_col], ts_col, window, "velocity_count", dense=dense)
    out = out.select("*", (F.col("velocity_count") >= n).alias("is_velocity"))
    if mark_burst:
        out = forward_max(out, [account_col], ts_col, window, "velocity_count", "_lg_burst", dense=dense)
        out = out.withColumn("is_velocity_burst", F.col("_lg_burst") >= n).drop("_lg_burst")
    return out


def detect_structuring(txns: DataFrame, lo: float = K.STRUCTURING_LO, hi: float = K.STRUCTURING_HI,
                       amount_col: str = "amount", channels: list[str] | None = None,
                       categories: list[str] | None = None) -> DataFrame:
    """O-D2: inclusive amount band; optional channel / category restriction."""
    cond = F.col(amount_col).between(F.lit(lo), F.lit(hi))
    if channels:
        cond = cond & F.col("channel").isin(channels)
    if categories:
        cond = cond & F.col("txn_category").isin(categories)
    return txns.withColumn("is_structuring", F.coalesce(cond, F.lit(False)))


def detect_cross_border(txns: DataFrame, high_risk: list[str] = K.HIGH_RISK_COUNTRIES,
                        country_col: str = "country_code") -> DataFrame:
    """O-D3: jurisdiction in the (small, fixed-size) high-risk list -> ``high_risk_country``."""
    return txns.withColumn("high_risk_country",
                           F.coalesce(F.col(country_col).isin(list(high_risk)), F.lit(False)))


def detect_round_number(txns: DataFrame, min_amount: float = K.ROUND_NUMBER_MIN,
                        step: float = K.ROUND_NUMBER_STEP, amount_col: str = "amount") -> DataFrame:
    """O-D4: amount > min and amount is a multiple of step."""
    a = F.col(amount_col)
    return txns.withColumn("is_round_number",
                           F.coalesce((a > F.lit(min_amount)) & (a % F.lit(step) == 0), F.lit(False)))


def _pick_score(pattern: Column, seed: Column) -> Column:
    out = None
    for p in K.FRAUD_PATTERNS:
        lo, hi = K.SCORE_RANGES[p]
        v = F.lit(lo) + F.pmod(seed, F.lit(hi - lo + 1))
        out = F.when(pattern == p, v) if out is None else out.when(pattern == p, v)
    lo, hi = K.SCORE_RANGES["NONE"]
    return out.otherwise(F.lit(lo) + F.pmod(seed, F.lit(hi - lo + 1))).cast("decimal(5,2)")


def default_score_seed(txn_id: Column) -> Column:
    """Numeric ids are used as-is; other ids are hashed (seedless and deterministic)."""
    return F.coalesce(txn_id.try_cast("bigint"), F.xxhash64(txn_id))


def classify_fraud(txns: DataFrame, *, velocity_n: int = K.VELOCITY_MIN_TXNS,
                   velocity_window: str = K.VELOCITY_WINDOW,
                   structuring: tuple[float, float] = (K.STRUCTURING_LO, K.STRUCTURING_HI),
                   high_risk: list[str] = K.HIGH_RISK_COUNTRIES,
                   round_min: float = K.ROUND_NUMBER_MIN, round_step: float = K.ROUND_NUMBER_STEP,
                   channels: list[str] | None = None, mark_burst: bool = False,
                   score_seed: Column | None = None, dense: DataFrame | None = None) -> DataFrame:
    """O-D5..O-D7: all detectors, then

    * ``patterns``: every rule hit, in precedence order VELOCITY, STRUCTURING, CROSS_BORDER, ROUND_NUMBER
    * ``fraud_pattern``: the first hit (primary pattern), ``is_flagged``
    * ``flag_score``: deterministic score inside the pattern's range
    * ``review_status`` / ``reviewed_by``: PENDING for flagged rows; a deterministic third is reviewed

    The row rules are the same column expressions as the single detectors, added in one projection.
    """
    df = detect_velocity(txns, velocity_n, velocity_window, mark_burst=mark_burst, dense=dense)
    a = F.col("amount")
    struct_hit = a.between(F.lit(structuring[0]), F.lit(structuring[1]))
    if channels:
        struct_hit = struct_hit & F.col("channel").isin(channels)
    struct_hit = F.coalesce(struct_hit, F.lit(False))
    xb_hit = F.coalesce(F.col("country_code").isin(list(high_risk)), F.lit(False))
    rnd_hit = F.coalesce((a > F.lit(round_min)) & (a % F.lit(round_step) == 0), F.lit(False))
    vel = F.col("is_velocity_burst") if mark_burst else F.col("is_velocity")
    hits = [(vel, "VELOCITY"), (struct_hit, "STRUCTURING"), (xb_hit, "CROSS_BORDER"), (rnd_hit, "ROUND_NUMBER")]
    primary = F.when(hits[0][0], hits[0][1])
    for cond, p in hits[1:]:
        primary = primary.when(cond, p)
    seed = score_seed if score_seed is not None else default_score_seed(F.col("txn_id"))
    flagged = primary.isNotNull()
    reviewed = flagged & (F.pmod(seed, F.lit(3)) == 0)
    return df.select(
        "*",
        struct_hit.alias("is_structuring"), xb_hit.alias("high_risk_country"), rnd_hit.alias("is_round_number"),
        F.array_compact(F.array(*[F.when(cond, F.lit(p)) for cond, p in hits])).alias("patterns"),
        primary.alias("fraud_pattern"),
        flagged.alias("is_flagged"),
        _pick_score(primary, seed).alias("flag_score"),
        F.when(reviewed, F.lit(K.REVIEWER)).alias("reviewed_by"),
        F.when(reviewed, F.when(F.pmod(seed, F.lit(5)) == 0, "CONFIRMED_FRAUD").otherwise("CLEARED"))
         .when(flagged, "PENDING").alias("review_status"))


def fraud_payload(cols: dict[str, Column] | None = None) -> Column:
    """O-D27: 11-key evidence object; NULL values are left out of the JSON."""
    c = F.col
    return F.to_json(F.struct(
        c("customer_id"), c("account_id"), c("txn_id"), c("amount"), c("channel"), c("country_code"),
        c("fraud_pattern"), c("flag_score"), c("txn_ts").cast("string").alias("txn_ts"),
        c("counterparty_account"), c("review_status")))


def own_number(txn_id: Column) -> Column:
    """The number that a transaction id is, if it fits the fraud range; null for every other id."""
    number = txn_id.try_cast("bigint")
    return F.when(number.between(F.lit(0), F.lit(ID_SPAN - 1)) & (number.cast("string") == txn_id), number)


def fraud_flag_id(txn_id: Column, registered: Column | None = None) -> Column:
    """A plain number that fits the fraud range keeps its own id there; every other transaction id has the number that
    the registry gave it.  Without a registry it gets a hash over all negative numbers, which no range of the three domains
    uses, but which two ids can share."""
    other = registered if registered is not None else F.xxhash64(F.lit("FRAUD"), txn_id).bitwiseOR(F.lit(-2 ** 63))
    return F.coalesce(F.lit(FRAUD_ID_BASE) + own_number(txn_id), other)


def flag_id_registry(spark, path: str) -> KeyRegistry:
    """The registry of flag ids for text transaction ids, above the ranges of the three domains."""
    return KeyRegistry(spark, path, TEXT_ID_BASE)


def register_flag_ids(classified: DataFrame, registry: KeyRegistry) -> DataFrame:
    """Registers the flagged transactions whose id is no number of the fraud range; the registry's pairs."""
    text = F.col("is_flagged") & own_number(F.col("txn_id")).isNull()
    return registry.register(classified.filter(text).select(F.col("txn_id").alias("key")))


def build_fraud_flags(classified: DataFrame, accounts: DataFrame, as_of: str = "2024-01-31 00:00:00",
                      ids: DataFrame | None = None) -> DataFrame:
    """O-D9: one FRAUD flag per flagged transaction, enriched with the account's customer.  ``ids``: the pairs of
    :func:`register_flag_ids`."""
    return conform(timed_fraud_flags(classified, accounts, as_of, ids), RISK_FLAGS_SCHEMA)


def timed_fraud_flags(classified: DataFrame, accounts: DataFrame, as_of: str = "2024-01-31 00:00:00",
                      ids: DataFrame | None = None) -> DataFrame:
    """The fraud flags with their transaction's time (``txn_ts``), for sinks that are partitioned by it."""
    acc = accounts.select("account_id", "customer_id")
    t = classified.filter(F.col("is_flagged"))
    j = t.join(acc, "account_id", "inner")
    registered = None
    if ids is not None:
        j = j.join(ids.select(F.col("key").alias("_lg_key"), F.col("id").alias("_lg_id")), F.col("txn_id") == F.col("_lg_key"), "left")
        registered = F.col("_lg_id")
    now = ts_lit(as_of)
    return j.select(
        fraud_flag_id(F.col("txn_id"), registered).alias("flag_id"),
        F.lit("FRAUD").alias("flag_domain"),
        F.col("fraud_pattern").alias("flag_type"),
        fraud_severity(F.col("fraud_pattern")).alias("severity"),
        F.coalesce(F.col("review_status"), F.lit("OPEN")).alias("flag_status"),
        "customer_id", "account_id", "txn_id",
        F.array(F.col("txn_id")).alias("evidence_txn_ids"),
        F.lit("flag_score").alias("threshold_field"),
        F.col("flag_score").cast("decimal(14,4)").alias("threshold_value"),
        F.lit(K.FRAUD_SCORE_LIMIT).cast("decimal(14,4)").alias("threshold_limit"),
        rationale(F.col("fraud_pattern")).alias("threshold_rationale"),
        fraud_payload().alias("evidence_payload"),
        "flag_score",
        now.alias("created_at"), now.alias("updated_at"), "txn_ts",
    )
