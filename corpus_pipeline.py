"""The corpus pipeline: documents in, packed token sequences out.

Language identification (documents without a language go), near-duplicates
(one document of each group stays), benchmark decontamination (documents with
leaked items go), personal data (found spans are replaced), packing.  Each
stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, langid, minmax, packing, pii
from lectern.llm.common import table, written
from lectern.llm.tokenizing import tokenizer_path
from lectern.runtime import ensure_checkpoint_dir, ship_package

BYTE_TOKENIZER = "byte_bpe_50k.json"

#: Whole texts go to the Python workers in batches of so many bytes, not of so
#: many rows: a batch lies in memory several times, in the executor and its
#: workers.  A session that sets its own bound keeps it.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; an unlabelled one gets the predicted label.
    Null texts and texts without a letter go.  Where nothing is labelled to
    learn from, the others keep their label, null or not."""
    _prepare(spark)
    network = langid.learned(docs)
    if network is None:
        return docs.where(langid.has_letter())
    found = langid.labelled(docs, network, "langid label", "langid score")
    named = F.coalesce("lang", "langid label")
    return found.where(langid.has_letter()).select(*[named.alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    _prepare(spark)
    return minmax.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    _prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced."""
    _prepare(spark)
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: one row per piece."""
    _prepare(spark)
    return packing.pack(docs, tokenizer_path(BYTE_TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The stages learn, hash and tokenise: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    _prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
