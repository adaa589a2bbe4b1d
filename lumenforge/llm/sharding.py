"""Proportional stratified interleaving into shards of equal row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import ranked, table


def interleave_shards(docs: DataFrame, shards: int = 24, seed: str = "interleave", source: str = "source") -> DataFrame:
    """Deal all rows into ``shards`` so that every shard has the corpus' mixture of sources.

    Rows are shuffled by a seeded hash within each source; the row of rank r of n gets the fractional rank
    (2r + 1) / 2n, all rows are ordered by it and the order is cut into equal parts. Law ``rows``: counts are at
    most one apart. A null source is a stratum of its own, a null text has no bytes, repeated rows each get a place
    of their own, an empty table gives no rows; other columns are not read.

    Neither order is made in one task: both ranks come from counts of hash buckets (`ranked`).
    Only ids, sizes and checksums are shuffled, never texts.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
    )
    ties = ["_key", "doc_id", "text_crc32", "size"]
    rows = ranked(rows, ["stratum"], F.substring("_key", 1, 3), ties, "_rank")
    totals = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("_of"))
    rows = rows.join(totals, "stratum").withColumn("fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_of")))
    rows = ranked(rows, [], F.floor(F.col("fraction") * 4096), ["fraction", "stratum", *ties], "_place")
    n = rows.groupBy().agg(F.count(F.lit(1)).alias("_rows"))
    first = (F.col("shard").cast("long") * F.col("_rows") + shards - 1).cast("long")
    return (
        rows.crossJoin(F.broadcast(n))  # one row
        .withColumn("shard", F.expr(f"_place * {shards} div _rows").cast("int"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("_place") - F.floor(first / shards)).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), F.col("stratum"), "fraction",
        )
    )


def op2_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(table(spark, sf_dir, "documents")).drop("stratum", "fraction")
