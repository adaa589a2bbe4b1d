"""A corpus pipeline of five training-data operators: each stage works on all that the one before it kept.

The pipeline is an application: it sets its session's Arrow batches to BATCH rows, since stages return results that are
computed when they are written, and texts can be long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import delete_folder, shared_folder, table
from lumenforge.llm.decontamination import decontaminate
from lumenforge.llm.ngram_join import distinct_documents
from lumenforge.llm.packing import default_tokenizer, pack_best_fit
from lumenforge.llm.secret_scan import redact_secrets
from lumenforge.llm.toxicity import learn_lexicon, toxicity_score


#: Rows that go to a Python worker at a time.
BATCH = 250


def _batched(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score is 0.5 or more.

    Null and empty texts score as texts without a hit; repeated rows are scored each and share a verdict; a row without an
    id is scored and not learned from; an empty table gives no rows; all columns come through.
    """
    _batched(spark)
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(lexicon) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, keeps the smallest id.

    Rows that repeat an id and text are one document, of which one row stays; other rows of an id and rows without one are
    documents of their own. Rows without words all stay; an empty table gives no rows; all columns come through.
    """
    _batched(spark)
    return distinct_documents(docs, k=5, threshold=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of a benchmark item, its parameters changed or not.

    The verdict rests on the text alone, so repeated ids and rows without one are judged alike; null and empty texts
    stay; an empty table gives no rows, an empty benchmark rejects nothing; all columns come through.
    """
    _batched(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; ``n_chars`` follows. Every row stays: null texts null, repeated rows each."""
    _batched(spark)
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 tokens; a null or empty text is one end token, repeated rows are packed each."""
    _batched(spark)
    return pack_best_fit(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Token ids and learned scores are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder before the next stage reads it, and is
    deleted once the next one's is there. The last one stays."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, f"{folder}/{before}")
        before = name
    return docs
