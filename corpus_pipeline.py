"""A training-corpus pipeline of five stages; each calls one operator of ``ledgerguard.llm``.

Every stage gets all documents that the one before kept, its result is written as Parquet to the shared
checkpoint folder and read back as the next one's input.  All but the last return the columns of documents.

The stages that run in Python set the session's Arrow batches to ``BATCH_ROWS`` documents.

Defined cases, stage by stage as the operators have them: documents without text or with few words go with the quality
rules; of near copies and repeated rows one row stays, null ids last; a contaminated row goes alone, also without an
id; columns other than ``text`` pass as they are, unmasked, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerguard.llm import bpe, decontaminate, near_dedup, pii, quality
from ledgerguard.llm.common import SHINGLE_WORDS, SIMILARITY, documents, stored
from ledgerguard.llm.queries import BYTE_BPE


#: Documents of an Arrow batch.  A task holds a batch in the JVM, one in Python, and what it makes of them (a text's
#: words take several times its bytes).
BATCH_ROWS = 1000
#: Words of the last stage's dictionary: it runs beside what the other stages have left in the JVM.
WORDS = 1 << 18


def _batched(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does, go."""
    return quality.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    _batched(spark)
    return near_dedup.one_of_each(docs, SHINGLE_WORDS, round(100 * SIMILARITY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    _batched(spark)
    return pii.mask_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, with digests of the ids and of the decoded text."""
    _batched(spark)
    return bpe.encode_decode(docs, BYTE_BPE, with_ids=True, dictionary=WORDS)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("tokens", tokens)]

#: SQL can express neither the tokens nor the masking; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
