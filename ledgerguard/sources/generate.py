"""Deterministic generators and literal inputs (O-S2..O-S5, O-W1).

The reference builds its demo tables with a row generator, row numbers and
``MOD`` arithmetic.  ``spark.range`` gives the row numbers without a global
window; the label rules are plain column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerguard.functions import constants as K

c = F.col

# --- fixed values: the demo generator's injection rules (row-number moduli) ---
VELOCITY_CYCLE, VELOCITY_SPAN = 33, 5      # rows 0-4 of every 33
STRUCTURING_EVERY = 50
CROSS_BORDER_EVERY = 75
ROUND_NUMBER_EVERY = 120


def lookup(values: list, index: Column) -> Column:
    """O-S4: 0-based lookup into a literal array (no one-row CTE, no join)."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def split_to_rows(spark: SparkSession, text: str, sep: str = ",") -> DataFrame:
    """O-S3: a delimited literal list as rows (value, index) with a 1-based index."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), sep)).alias("pos", "value")).select(
        "value", (c("pos") + 1).alias("idx"))


def injected_labels(rn: Column) -> dict[str, Column]:
    """The demo generator's labels for row number ``rn`` (first match wins)."""
    vel = (rn % VELOCITY_CYCLE) < VELOCITY_SPAN
    struct = rn % STRUCTURING_EVERY == 0
    xb = rn % CROSS_BORDER_EVERY == 0
    rnd = rn % ROUND_NUMBER_EVERY == 0
    pattern = (F.when(vel, "VELOCITY").when(struct, "STRUCTURING").when(xb, "CROSS_BORDER")
               .when(rnd, "ROUND_NUMBER"))
    return {"fraud_pattern": pattern, "is_flagged": pattern.isNotNull()}


def generate_transactions(spark: SparkSession, n: int, accounts: int = 800,
                          num_partitions: int | None = None) -> DataFrame:
    """O-S2 / O-W1: ``n`` labelled synthetic transactions; row numbers from ``spark.range``."""
    rn = c("id")
    labels = injected_labels(rn)
    df = spark.range(1, n + 1, numPartitions=num_partitions)
    return df.select(
        rn.alias("rn"),
        F.concat(F.lit("REF"), F.lpad(rn.cast("string"), 10, "0")).alias("reference_no"),
        (rn % accounts + 1).alias("account_id"),
        lookup(K.CHANNELS, rn % len(K.CHANNELS)).alias("channel"),
        lookup(K.TXN_CATEGORIES, rn % len(K.TXN_CATEGORIES)).alias("txn_category"),
        F.when(rn % CROSS_BORDER_EVERY == 0, lookup(K.HIGH_RISK_COUNTRIES, rn % 10))
         .otherwise(lookup(K.GENERATED_COUNTRIES, rn % len(K.GENERATED_COUNTRIES)))
         .alias("country_code"),
        F.when(rn % 3 == 0, "CREDIT").otherwise("DEBIT").alias("txn_type"),
        labels["fraud_pattern"].alias("fraud_pattern"),
        labels["is_flagged"].alias("is_flagged"),
    )


def label_counts(df: DataFrame) -> DataFrame:
    return df.filter(c("is_flagged")).groupBy("fraud_pattern").agg(F.count(F.lit(1)).alias("n"))
