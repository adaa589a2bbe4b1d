"""Fixity audit of WARC replicas by Merkle trees over ordered offset ranges.

A leaf is a record's range in its file with its hash. A node covers an aligned stretch of offsets: BLOCK bytes, then
FANOUT times as many, up to a whole file; then FANOUT files, and so on up to one root. So both copies have their nodes at
the same places, whatever ranges they hold, and a node of few children is hashed in one small group. A node of one child
has that child's hash: a taller tree has the same root. An audit compares the roots, then only the children of nodes that
differ, and so meets ranges that either copy lacks too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenforge.llm.common import few_files, materialise, table

#: Ids that share a file, children of a node, bytes of a lowest one.
IDS_PER_FILE, FANOUT, BLOCK = 1_000, 16, 1 << 16


def warc_record(url: str = "url", body: str = "html") -> Column:
    """The text of a WARC/1.1 resource record; null urls and bodies count as empty."""
    b = F.coalesce(F.col(body), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n\r\n"), b, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, file, record): a file holds the pages of IDS_PER_FILE successive ids. Pages without an id are dealt by
    their content to files of their own, of about as many pages, with negative odd numbers."""
    loose = pages.where("page_id is null").count() // IDS_PER_FILE + 1
    dealt = F.pmod(F.conv(F.substring(F.md5(F.col("record").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(loose))
    file = F.coalesce(F.floor(F.col("page_id") / IDS_PER_FILE) * 2, -1 - 2 * dealt).cast("long")
    return pages.select("page_id", warc_record().alias("record")).select("page_id", file.alias("file"), "record")


def leaves(found: DataFrame, *kept: str) -> DataFrame:
    """(page_id, file, start, end, hash, kept columns): every record's place in its file and its SHA-256, files in the
    order of ids and hashes. Rows that repeat have a place each.

    Records are hashed where they are read; only hashes and lengths are shuffled. Equal rows are counted first, and
    offsets come from the sums of parts of an id's records, so that an id of very many pages is no single task.
    """
    slim = found.select("page_id", "file", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("hash"), *kept)
    slim = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("times")).withColumn("part", F.substring("hash", 1, 2))
    size = F.col("length") * F.col("times")
    sums = slim.groupBy("file", "page_id", "part").agg(F.sum(size).alias("bytes"))
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", F.col("page_id").alias("id"), F.col("part").alias("p"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = slim.alias("s").join(base.alias("b"), F.expr("s.file = b.file and s.page_id <=> b.id and s.part = b.p")).select("s.*", "base")
    within = Window.partitionBy("file", "page_id", "part").orderBy("hash", *kept).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first", F.col("base") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    each = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("first") + F.col("k") * F.col("length")
    return each.select("page_id", "file", start.alias("start"), (start + F.col("length")).alias("end"), "hash", *kept)


def _parents(children: DataFrame, file: Column, at: Column, order: list[str]) -> DataFrame:
    """Nodes (side, file, at, hash): the hash of their children's places and hashes, in order; of a single node, its hash."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "hash"))), lambda c: F.concat_ws(":", *(c[o] for o in order), c["hash"])), ";")
    whole = F.sha2(text.cast("binary"), 256)
    keyed = children.select("side", file.cast("long").alias("up_file"), at.cast("long").alias("up_at"), *order, "hash")
    hashed = whole if "start" in order else F.when(F.count(F.lit(1)) == 1, F.max("hash")).otherwise(whole)
    return keyed.groupBy("side", "up_file", "up_at").agg(hashed.alias("hash")).select("side", F.col("up_file").alias("file"), F.col("up_at").alias("at"), "hash")


def tree(sides: DataFrame, files: int, fanout: int = FANOUT, block: int = BLOCK) -> list[tuple[DataFrame, Column, Column]]:
    """Levels above leaves (side, file, start, end, hash), lowest first, up to one root for each side: nodes (side, file, at,
    hash) and where those of the level below have their parent among them. Each is written before the next is made of it."""
    up = (F.col("file"), F.expr(f"start div {block}"))
    levels = [(materialise(_parents(sides, *up, ["start", "end"]), files), *up)]
    while True:
        below = levels[-1][0]
        top = below.agg(F.max("at").alias("at"), F.min("file").alias("low"), F.max("file").alias("high")).first()
        if top.at is None or (top.at == 0 and top.low == top.high):
            return levels
        if top.at:
            up, order = (F.col("file"), F.expr(f"at div {fanout}")), ["at"]
        elif (top.low, top.high) == (-1, 0):  # files without ids, and the others
            up, order = (F.lit(0), F.lit(0)), ["file"]
        else:
            up, order = (F.floor(F.col("file") / fanout), F.lit(0)), ["file"]
        levels.append((materialise(_parents(below, *up, order), files), *up))


def descend(sides: DataFrame, levels: list[tuple[DataFrame, Column, Column]]) -> tuple[DataFrame, list[DataFrame]]:
    """(file, start, end) of the ranges that differ, and the nodes that are compared at each level, the roots first."""

    def unlike(rows: DataFrame, *keys: str) -> DataFrame:
        both = rows.groupBy(*keys).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.min("hash").alias("x"), F.max("hash").alias("y"))
        return both.where("a != b or x != y").select(*keys)

    compared = [levels[-1][0]]
    for k in range(len(levels) - 1, -1, -1):
        _, file, at = levels[k]
        differ = unlike(compared[-1], "file", "at").select(F.col("file").alias("up_file"), F.col("at").alias("up_at"))
        below = levels[k - 1][0] if k else sides
        rows = below.withColumns({"up_file": file.cast("long"), "up_at": at.cast("long")}).join(differ, ["up_file", "up_at"], "left_semi")
        compared.append(rows.drop("up_file", "up_at"))
    return unlike(compared[-1], "file", "start", "end"), compared


def audit(index: DataFrame, stored: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """(page_id, file, start, end, sha256, found, corrupt, root, replica_root) of every record of an index, as `leaves`
    makes it, and of every range that only the replica has (without page_id and sha256).

    ``stored`` (file, start, end, hash) is what a replica's ranges hash to now; its tree is made of these alone. A range
    that either side lacks, or that hashes differently or to null, is corrupt; a range that repeats on one side only too.
    The roots are those of the two trees. Empty tables give no rows (an empty index those of the replica); other columns,
    and clashing names among them, are not read.
    """
    files = few_files(index)
    index = materialise(index.select("page_id", "file", "start", "end", "hash"), files)
    ranges = lambda df, side: df.select(F.lit(side).alias("side"), "file", "start", "end", F.coalesce("hash", F.lit("")).alias("hash"))
    sides = materialise(ranges(index, 0).union(ranges(stored, 1)), files)
    levels = tree(sides, files, fanout, block)
    bad, _ = descend(sides, levels)
    roots = {r.side: r.hash for r in levels[-1][0].collect()}  # one for each side
    now = sides.where("side = 1").groupBy("file", "start", "end").agg(F.max("hash").alias("found"))
    marked = now.join(bad.withColumn("bad", F.lit(True)), ["file", "start", "end"], "full")
    rows = index.withColumnRenamed("hash", "sha256").join(marked, ["file", "start", "end"], "full")
    root = lambda side: F.lit(roots.get(side)).cast("string")
    return rows.select("page_id", "file", "start", "end", "sha256", F.nullif("found", F.lit("")).alias("found"), F.coalesce("bad", F.lit(False)).alias("corrupt"), root(0).alias("root"), root(1).alias("replica_root"))


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which decay is simulated: by the MD5 of their id, some records have a flipped bit
    and some are lost."""
    key = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    found = records(table(spark, sf_dir, "pages"))
    decayed = F.when(key.startswith("00"), F.concat(F.lit("V"), F.substring("record", 2, 2_000_000_000))).otherwise(F.col("record"))
    both = materialise(leaves(found.withColumn("now", F.when(~key.startswith("01"), F.sha2(decayed.cast("binary"), 256))), "now"), few_files(found))
    return audit(both.drop("now"), both.where("now is not null").select("file", "start", "end", F.col("now").alias("hash")))


def op3_sql() -> str:
    """The same for DuckDB: taller trees than its tables need have the same roots."""
    key = "MD5(COALESCE(CAST(page_id AS VARCHAR), ''))"
    with_ = rf"""pages_ AS (SELECT page_id, CONCAT('WARC/1.1', e, 'WARC-Type: resource', e, 'WARC-Target-URI: ', url, e, 'Content-Type: text/html', e, 'Content-Length: ',
        OCTET_LENGTH(ENCODE(html)), e, e, html, e, e) AS r FROM (SELECT page_id, COALESCE(url, '') AS url, COALESCE(html, '') AS html, CONCAT(chr(13), chr(10)) AS e FROM pages) p),
      dealt AS (SELECT page_id, r, COALESCE(CAST(FLOOR(page_id / {IDS_PER_FILE}) * 2 AS BIGINT), -1 - 2 * (CAST(CONCAT('0x', LEFT(MD5(r), 8)) AS BIGINT) % (SELECT COUNT(*) // {IDS_PER_FILE} + 1 FROM pages WHERE page_id IS NULL))) AS file FROM pages_),
      hashed AS (SELECT page_id, file, SHA256(r) AS sha256, OCTET_LENGTH(ENCODE(r)) AS n, CASE WHEN {key} LIKE '00%' THEN SHA256(CONCAT('V', SUBSTR(r, 2))) WHEN {key} NOT LIKE '01%' THEN SHA256(r) END AS found FROM dealt),
      idx AS (SELECT page_id, file, CAST(SUM(n) OVER w - n AS BIGINT) AS a, CAST(SUM(n) OVER w AS BIGINT) AS b, sha256, found FROM hashed WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS LAST, sha256 ROWS UNBOUNDED PRECEDING)),
      sides AS (SELECT 0 AS side, file, a, b, sha256 AS h FROM idx UNION ALL SELECT 1, file, a, b, found FROM idx WHERE found IS NOT NULL),
      n0 AS (SELECT side, file, a // {BLOCK} AS place, SHA256(STRING_AGG(CONCAT(a, ':', b, ':', h), ';' ORDER BY a, b, h)) AS h FROM sides GROUP BY ALL)"""
    node = "CASE WHEN COUNT(*) = 1 THEN MAX(h) ELSE SHA256(STRING_AGG(CONCAT({0}, ':', h), ';' ORDER BY {0})) END AS h"
    for k in range(1, 9):
        file, place = ("file", f"place // {FANOUT}") if k < 5 else (f"CAST(FLOOR(file / {FANOUT}) AS BIGINT)", "0")
        with_ += f", n{k} AS (SELECT side, {file} AS up_file, {place} AS up_place, {node.format('place' if k < 5 else 'file')} FROM {f"m{k - 1}" if k > 1 else "n0"} GROUP BY 1, 2, 3)"
        with_ += f", m{k} AS (SELECT side, up_file AS file, up_place AS place, h FROM n{k})"
    root = f"(SELECT {node.format('file')} FROM m8 WHERE side = {{}})"
    return f"""WITH {with_} SELECT page_id, file, a AS start, b AS "end", sha256, found, found IS DISTINCT FROM sha256 AS corrupt, {root.format(0)} AS root, {root.format(1)} AS replica_root FROM idx"""
