"""Shared pieces of the training-data operators: cutting lineage, distributed ranks, vectorised word hashes."""

from __future__ import annotations

import ctypes
import math
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast, after they have been counted. 16 bytes a row: 8 MB at most.
BROADCAST_ROWS = 500_000
#: Bytes of text that a worker hashes at a time.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 250) -> Iterator[None]:
    """Arrow batches of a few rows for the jobs that run inside: packed rows are large. The session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names. Only a local session, as in tests, may name none: it gets a fresh one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate results, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder, in at most ``parts`` files (see `few_files`)."""
    shared_folder(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint(eager=True)


def bucket_plan(items: float, pack: int, bucket: int, full: int = 64) -> tuple[int, int]:
    """(items a worker packs at once, bits of the bucket number) for a packed exchange of so many items.

    A bucket should hold ``bucket`` items, and a packed row ``full`` of them at least: pack x bucket >= full x items. From
    some 100 GB of text on, both grow with the square root of the input: at 100 TB, tasks hold some 40 million items.
    """
    scale = math.isqrt(int(full * items)) + 1
    pack, bucket = max(pack, scale), max(bucket, scale)
    return pack, max(0, min(24, round(math.log2(max(1.0, items / bucket)))))


def few_files(source: DataFrame) -> int:
    """Files for narrow tables made from a source: one for each 64 MB of it, 8 at least. A file for each shuffle
    partition would be thousands of tiny ones, each with its own round trip to the store."""
    return max(8, plan_bytes(source) >> 26)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a relation's size: file sizes, for a scan. Where it has none, the bytes of all strings."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 60:
        return size
    texts = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind == "string"]
    return sum(x or 0 for x in df.agg(*texts).first()) if texts else 0


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a narrow relation has few enough rows to be broadcast (counts no further than it must)."""
    return df.limit(rows + 1).count() <= rows


def by_id(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a one-column relation: broadcast when its counted size is bounded, shuffled otherwise."""
    return df.join(F.broadcast(ids) if small(ids) else ids, key, how)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that a relation doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, strata: list[str], bucket: Column, order: list[str], rank: str) -> DataFrame:
    """Rank rows within strata from 0 without ordering any stratum in one task.

    ``bucket`` must grow with ``order``; rows are ordered only within (stratum, bucket), and a running
    sum over the bucket counts gives each bucket its first rank. A hot stratum spreads over its buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*strata, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*strata, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_row", F.row_number().over(within))
        .join(starts, [*strata, "_bucket"])
        .withColumn(rank, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_bucket", "_row", "_start")
    )


# ---- rows as documents --------------------------------------------------------------------------------------


@dataclass
class Documents:
    """``rows`` (doc_id, text): ids unique, neither null. ``again`` (doc_id, given, times): for the numbers of what had no
    id of its own or stands in several rows, the id that it came with and its rows; None where there is none."""

    rows: DataFrame
    again: DataFrame | None

    def restore(self, result: DataFrame) -> DataFrame:
        """A result by ``doc_id`` with the ids that the rows came with, one row for each of them."""
        if self.again is None:
            return result
        joined = result.join(self.again, "doc_id", "left").withColumn("_each", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
        return joined.select(F.when(F.col("times").isNull(), F.col("doc_id")).otherwise(F.col("given")).alias("doc_id"), *(c for c in result.columns if c != "doc_id"))


def documents(docs: DataFrame) -> Documents:
    """One document for each id and text. Rows that repeat both are one document; of different texts under one id the one
    of least MD5 keeps the id; the others, and texts without an id, get numbers above all ids, in the order of (id, MD5).

    Only ids are read to see whether there is anything to do; only the rows concerned are hashed and shuffled then.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    seen = ids.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("most"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("top")).first()
    if seen.most <= 1 and not seen.none:
        return Documents(rows, None)
    twice = materialise(ids.where("_n > 1 and doc_id is not null").select("doc_id"), few_files(docs))
    key = F.md5(F.col("text").cast("binary")).alias("_md5")
    odd = by_id(rows.where("doc_id is not null"), twice, "doc_id", "left_semi").union(rows.where("doc_id is null"))
    each = odd.select("doc_id", "text", key).groupBy("doc_id", "_md5").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))  # equal rows meet in each task first
    each = materialise(each, few_files(docs))
    narrow = each.select("doc_id", "_md5", "times")
    firsts = narrow.where("doc_id is not null").groupBy("doc_id").agg(F.min("_md5").alias("_least"))
    marked = narrow.join(firsts, "doc_id", "left").withColumn("_own", F.coalesce(F.col("_md5") == F.col("_least"), F.lit(False)))
    rest = ranked(marked.where("not _own"), [], F.when(F.col("doc_id").isNull(), F.concat(F.lit("1"), F.substring("_md5", 1, 3))).otherwise(F.lit("0")), ["doc_id", "_md5"], "_rank")
    own, rest = marked.where("_own").select("doc_id", "_md5", "times", F.col("doc_id").alias("_no")), rest.select("doc_id", "_md5", "times", (F.lit(seen.top + 1) + F.col("_rank")).alias("_no"))
    numbers = materialise(own.union(rest), few_files(docs))
    texts = each.drop("times").alias("e").join(numbers.alias("n"), F.expr("e.doc_id <=> n.doc_id and e._md5 = n._md5")).select(F.col("_no").alias("doc_id"), "text")
    plain = by_id(rows.where("doc_id is not null"), twice, "doc_id", "left_anti")
    return Documents(plain.union(texts), numbers.select(F.col("_no").alias("doc_id"), F.col("doc_id").alias("given"), "times"))


# ---- words, hashed in numpy ---------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: A random code for each byte; LOWER gives A-Z the codes of a-z.
LOWER = _CODES.copy()
LOWER[65:91] = _CODES[97:123]
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 2 * CHUNK_BYTES) + 1, base, np.uint64)
        got[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(got)
    return got


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, spaces: np.ndarray = SPACES, codes: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of a byte array; equal words have equal hashes wherever they stand."""
    starts, ends = runs(~spaces[buf])
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * powers(BASE, len(buf))[: len(buf)], out=total[1:])
    inverse = powers(pow(BASE, -1, 1 << 64), len(buf))
    return mix((total[ends] - total[starts]) * inverse[starts]), starts, ends


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Views of some rows at a time, so that only those become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, texts as UTF-8; null: empty) of some rows at a time. Column 0 is the id, column 1 the text."""
    ids, texts, held = [], [], 0
    for batch in slices(batches):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1]) + 1
            if held >= size or len(ids) >= 20_000:
                yield _ids(ids), texts
                ids, texts, held = [], [], 0
    if ids:
        yield _ids(ids), texts


def release() -> None:
    """Give a worker's free memory back to the system: workers stay for other tasks, and an executor's memory is theirs too."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library can't
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function on batches that gives free memory back at the end of a task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def _ids(ids: list[int | None]) -> np.ndarray:
    return np.array(ids, object if None in ids else np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a line feed after each, and where each starts."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return buf, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every window of k words; a shorter text with words gives one hash of all its words."""
    buf, at = joined(texts)
    words, starts, _ = word_hashes(buf)
    row = np.searchsorted(at, starts, side="right") - 1
    if not len(words):
        return row, words

    def fold(first: np.ndarray, n: int) -> np.ndarray:
        h = words[first]
        for j in range(1, n):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[first + j]
        return mix(h + np.uint64(n))

    first = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    rows, hashes = [row[first]], [fold(first, k)]
    counts = np.bincount(row, minlength=len(texts))
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for n in range(1, k):
        few = np.flatnonzero(counts == n)
        rows.append(few)
        hashes.append(fold(begins[few], n))
    return np.concatenate(rows), np.concatenate(hashes)
