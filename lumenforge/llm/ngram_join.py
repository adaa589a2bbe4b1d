"""Exact n-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

1. One pass over the texts hashes every document's shingles and deals them, packed by hash bucket, with the counts of
   each chunk's distinct shingles ahead of them (`_pack`).
2. A bucket sums the counts into document frequencies and streams the packed shingles past them; a document gets back
   only those shingles that another document has too, with a frequency class (`_reply`).
3. The global orders sort by frequency class, rarest first, and differ by a seeded hash within a class. With threshold
   t, two linked documents share one of the first n - ceil(tn) + 1 shingles under every order. What no one else has
   stands first and can't match, so most documents have nothing left to index (`_prefixes`).
4. Only pairs that share a prefix shingle under every order, and whose sizes and shared counts allow the overlap, are
   verified on their full shingle sets (`intersected`). Each posting list is first compared with its most central
   document only; pairs whose lists have that centre under one order but not the other are left to the next step. Then
   what is still in another component than most of its list is compared with the whole list. So no group of near copies
   is expanded into all its pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import BROADCAST_ROWS, bucket_plan, by_id, chunks, documents, few_files, materialise, mix, plan_bytes, shingles, slices, small, small_batches, table, trimmed

#: Shingles that a worker packs at once, and shingles that a bucket should hold (see `bucket_plan`).
PACK, BUCKET = 400_000, 500_000
#: Documents of a chunk at most: they are numbered in 16 bits. Those of one read come on top.
MOST_ROWS = 40_000
#: Documents of a posting list that meet others in one task.
LIST = 512
LOW = np.uint64(0xFFFFFFFF)
PACKED = "bucket int, kind int, chunk long, docs binary, lens binary, toks binary, counts binary"
REPLY = "chunk long, bucket int, docs binary, lens binary, toks binary, classes binary"


def doc_shingles(batches: Iterator[pa.RecordBatch], k: int, at_least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row, hash): the distinct shingles of some documents at a time, sorted by row and hash."""
    ids, rows, toks, n, m = [], [], [], 0, 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, tok = np.concatenate(rows), np.concatenate(toks)
        order = np.lexsort((tok, row))
        row, tok = row[order], tok[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (tok[1:] != tok[:-1])
        return np.concatenate(ids), row[new], tok[new]

    for got, texts in chunks(batches):
        row, tok = shingles(texts, k)
        ids.append(got)
        rows.append(row + n)
        toks.append(tok)
        n, m = n + len(got), m + len(tok)
        if m >= at_least or n >= MOST_ROWS:
            yield flush()
            ids, rows, toks, n, m = [], [], [], 0, 0
    if ids:
        yield flush()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)) if len(keys) else cut, np.concatenate((cut, [len(keys)])) if len(keys) else cut


def _pack(docs: DataFrame, k: int, bits: int, pack: int) -> DataFrame:
    shift = np.uint64(64 - bits)
    down = np.uint64(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (ids, row, tok) in enumerate(doc_shingles(batches, k, pack)):
            n = np.bincount(row, minlength=len(ids)).astype("<i8")
            sig = np.zeros((len(ids), 2), "<u8")
            if len(row):
                first, _ = _groups(row)
                sig[row[first], 0] = np.add.reduceat(mix(tok), first)
                sig[row[first], 1] = np.add.reduceat(mix(tok ^ LOW), first)
            chunk = int.from_bytes(hashlib.md5(ids.tobytes() + sig.tobytes()).digest()[:7])
            out: list[tuple] = [(turn % (1 << bits), 2, chunk, ids.tobytes(), n.tobytes(), sig.tobytes(), None)]
            short = ((tok >> down) & LOW).astype("<u4") if bits else (tok >> np.uint64(32)).astype("<u4")
            bucket = (tok >> shift).astype(np.int32) if bits else np.zeros(len(tok), np.int32)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            bucket, short, row = bucket[order], short[order], row[order]
            for a, b in zip(*_groups(bucket), strict=True):
                uniq, times = np.unique(short[a:b], return_counts=True)
                out.append((int(bucket[a]), 0, None, None, None, uniq.tobytes(), times.astype("<u4").tobytes()))
                s, e = _groups(row[a:b])
                out.append((int(bucket[a]), 1, chunk, row[a:b][s].astype("<u2").tobytes(), (e - s).astype("<u2" if e[-1] < 65_536 else "<u4").tobytes(), short[a:b].tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "kind", "chunk", "docs", "lens", "toks", "counts"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), PACKED)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    tok = np.concatenate([p[0] for p in parts])
    order = np.argsort(tok, kind="stable")
    tok, n = tok[order], np.concatenate([p[1] for p in parts])[order]
    first, _ = _groups(tok)
    return tok[first], np.add.reduceat(n, first) if len(tok) else n


def _reply(packed: DataFrame, parts: int) -> DataFrame:
    """Rows of a bucket come counts first, so that only its distinct shingles are held, never its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, toks, classes, held = -1, [], None, None, 0
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    at, counts, toks, held = r["bucket"], [], None, 0
                if r["kind"] == 0:
                    counts.append((np.frombuffer(r["toks"], "<u4"), np.frombuffer(r["counts"], "<u4").astype(np.int64)))
                    held += len(counts[-1][0])
                    if held > 2 * BUCKET and len(counts) > 1:
                        counts = [_merge(counts)]
                        held = len(counts[0][0]) // 2  # merge again when as much has come on top
                    continue
                if r["kind"] == 2:
                    out.append((r["chunk"], -1, r["docs"], r["lens"], r["toks"], None))
                    continue
                if toks is None:
                    toks, n = _merge(counts)
                    classes, counts = np.minimum(np.log2(n), 40).astype(np.uint8) * (n > 1), []
                docs, mine = np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["toks"], "<u4")
                lens = np.frombuffer(r["lens"], f"<u{len(r['lens']) // len(docs)}").astype(np.int64)
                c = classes[np.searchsorted(toks, mine)]
                common = c > 0
                each = np.add.reduceat(common.astype(np.int64), np.cumsum(lens) - lens)
                some = each > 0
                out.append((r["chunk"], at, docs[some].tobytes(), each[some].astype("<u4").tobytes(), mine[common].tobytes(), c[common].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["chunk", "bucket", "docs", "lens", "toks", "classes"])

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(trimmed(run), REPLY)


def _prefixes(replies: DataFrame, parts: int, threshold: tuple[int, int], orders: int) -> DataFrame:
    """One row a document: its set's size and signature and, if it may have links, its prefix under every order.

    The replies of a chunk, which hold no more shingles than the chunk had, meet again.
    """
    p, q = threshold

    def of(rows: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        doc, tok, c = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for r in rows:
            if r["bucket"] >= 0:
                doc.append(np.repeat(np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["lens"], "<u4").astype(np.int64)))
                tok.append(np.frombuffer(r["toks"], "<u4").astype(np.uint64) | np.uint64(r["bucket"] << 32))
                c.append(np.frombuffer(r["classes"], np.uint8))
        doc, tok, c = np.concatenate(doc), np.concatenate(tok), np.concatenate(c)
        order = np.lexsort((tok, doc))
        doc, tok, c = doc[order], tok[order], c[order]
        # Different shingles of a document may have one short hash; each of them counts as shared.
        for r in rows:
            if r["bucket"] >= 0:
                continue
            ids, sizes, sig = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["lens"], "<i8"), r["toks"]
            first, last = (np.searchsorted(doc, np.arange(len(ids), dtype=np.uint16), side=x) for x in ("left", "right"))
            for i, (d, n, a, b) in enumerate(zip(ids.tolist(), sizes.tolist(), first.tolist(), last.tolist(), strict=True)):
                least = -(-p * n // q)  # the overlap that any partner needs at least
                if not n or b - a < least:
                    out.append((d, n, sig[16 * i : 16 * i + 16], b - a, 0.0, None))
                    continue
                take = max(1, b - a - least + 1)  # of n - least + 1, what no one else has stands first
                keep = [list(dict.fromkeys(tok[a:b][np.lexsort((mix(tok[a:b] + np.uint64(s * 0x51ED270B)), c[a:b]))[:take]].astype(np.int64).tolist())) for s in range(orders)]
                out.append((d, n, sig[16 * i : 16 * i + 16], b - a, float(c[a:b].sum()) / n, keep))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.int64()))), strict=True)], names=["doc_id", "n", "sig", "shared", "central", "prefixes"])

        for batch in slices(batches, 32):
            for r in batch.to_pylist():
                if r["chunk"] != at:
                    if held:
                        yield batch_of(of(held))
                    at, held = r["chunk"], []
                held.append(r)
        if held:
            yield batch_of(of(held))

    return replies.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(run), "doc_id long, n long, sig binary, shared long, central double, prefixes array<array<long>>")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets pass. The sets of b meet that of a in blocks of some hundreds."""
    p, q = threshold
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))
    roles = pairs.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role")).union(pairs.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("role")).distinct())
    sets_of = by_id(docs.select("doc_id", "text"), roles.select("doc_id").distinct(), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, tok in doc_shingles(batches, k, PACK // 2):
            s, e = _groups(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[s]]), pa.array([tok[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary())], names=["doc_id", "toks"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, None
        for batch in slices(batches):
            a_out, b_out = [], []
            for a, salt, role, doc, toks in zip(*(batch[c].to_pylist() for c in ("a", "salt", "role", "doc_id", "toks")), strict=True):
                theirs = np.frombuffer(toks, np.uint64)
                if role == 0:
                    at, mine = (a, salt), theirs
                elif at == (a, salt):
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    if q * both >= p * (len(mine) + len(theirs) - both):
                        a_out.append(a)
                        b_out.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    found = sets_of.mapInArrow(trimmed(sets), "doc_id long, toks binary")
    met = found.join(F.broadcast(roles) if small(roles, BROADCAST_ROWS) else roles, "doc_id")
    return met.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").select("a", "salt", "role", "doc_id", "toks").mapInArrow(trimmed(compare), "a long, b long")


def components(nodes: DataFrame, links: DataFrame, files: int | None = None) -> DataFrame:
    """(doc_id, component): the smallest id that links reach, by min labels with pointer jumping until nothing changes."""
    links = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), files)
    labels = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "doc_id")
    labels = materialise(labels, files)
    while True:
        near = links.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("l").alias("m"))
        step = labels.join(near, "doc_id").select("doc_id", "l", F.least("l", "m").alias("x"))
        jump = labels.select(F.col("doc_id").alias("x"), F.col("l").alias("y"))
        new = materialise(step.join(jump, "x", "left").select("doc_id", F.least("x", F.coalesce("y", "x")).alias("l"), (F.least("x", F.coalesce("y", "x")) != F.col("l")).alias("moved")), files)
        labels = new.select("doc_id", "l")
        if new.where("moved").isEmpty():
            break
    return nodes.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("l", "doc_id").alias("component"))


def intersected(pairs: DataFrame, orders: int) -> DataFrame:
    """Of pairs (a, b, s) met in a posting list of order s, those met under every order."""
    met = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("s"))).alias("orders")
    return pairs.groupBy("a", "b").agg(met).where(F.col("orders") == (1 << orders) - 1).select("a", "b")


def _linked(docs: DataFrame, k: int, threshold: tuple[int, int], orders: int) -> DataFrame:
    """(doc_id, n, component) of documents with unique ids."""
    p, q = threshold
    if math.gcd(p, q) > 1:
        p, q = p // math.gcd(p, q), q // math.gcd(p, q)
    pack, bits = bucket_plan(plan_bytes(docs) / 4, PACK, BUCKET)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    files = few_files(docs)
    info = materialise(_prefixes(_reply(_pack(docs, k, bits, pack), parts), parts, (p, q), orders), files)
    # One document stands for each set; wordless ones stand for themselves.
    reps = info.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    post = (
        info.where("prefixes is not null").join(reps.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", "n", "shared", "central", F.posexplode("prefixes").alias("s", "toks"))
        .select("doc_id", "n", "shared", "central", "s", F.posexplode("toks").alias("i", "tok"))
        .withColumn("place", F.expr("n - shared + 1 + i")).drop("i")
    )
    lists = post.groupBy("s", "tok").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("other"), "n", "shared", "place")).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
    post = materialise(post.join(lists.drop("m"), ["s", "tok"]), files)

    def may(a: str, b: str) -> str:
        """What a linked pair must have: sizes, shared counts, and enough left behind its first common shingle's places
        under the order (whole numbers: overlap >= p / (p + q) of the sizes' sum)."""
        least = f"{p} * ({a}n + {b}n)"
        return (f"{q} * least({a}n, {b}n) >= {p} * greatest({a}n, {b}n) and {p + q} * least({a}shared, {b}shared) >= {least} "
                f"and {p + q} * (1 + least({a}n - {a}place, {b}n - {b}place)) >= {least}")  # fmt: skip

    star = post.where("doc_id != -head.other").where(may("", "head.")).select((-F.col("head.other")).alias("a"), F.col("doc_id").alias("b"), "s")
    links = materialise(_verified(docs, materialise(intersected(star, orders), files), k, (p, q)), files)
    labels = components(post.select("doc_id").distinct(), links, files)
    tagged = materialise(post.drop("head", "central").join(labels, "doc_id"), files)
    sizes = tagged.groupBy("s", "tok", "component").agg(F.count(F.lit(1)).alias("m"))
    most = sizes.groupBy("s", "tok").agg(F.max(F.struct("m", "component")).alias("main"), F.count(F.lit(1)).alias("c"), F.sum("m").alias("of")).where("c > 1")
    most = most.select("s", "tok", F.col("main.component").alias("main"), F.ceil(F.col("of") / LIST).cast("int").alias("blocks"))
    mixed = tagged.join(most, ["s", "tok"])  # a long list is dealt in blocks; what is not in its main component meets each of them
    y = mixed.select("s", "tok", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), *(F.col(c).alias(f"y_{c}") for c in ("doc_id", "n", "shared", "place", "component")))
    x = mixed.where("component != main").select("s", "tok", "main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "shared", "place", "component")))
    rest = x.join(y, (x.s == y.s) & (x.tok == y.tok) & (x.block == y.block) & (x.x_component != y.y_component) & ((y.y_component == x.main) | (x.x_doc_id < y.y_doc_id)) & F.expr(may("x_", "y_")))
    rest = rest.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"), x.s)
    more = _verified(docs, materialise(intersected(rest, orders), files), k, (p, q))
    labels = components(reps, links.union(more), files)
    of_set = reps.join(labels, "doc_id").select("sig", "component")
    return info.join(of_set.withColumn("has", F.lit(True)), (info.sig == of_set.sig) & (info.n > 0), "left").select(info.doc_id, info.n, F.coalesce("component", info.doc_id).alias("component"))


def jaccard_components(docs: DataFrame, k: int = 4, threshold: tuple[int, int] = (85, 100), orders: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, linked where the Jaccard similarity of the sets of word k-grams
    is at least ``threshold`` (a fraction p, q).

    A text with fewer than k words has its whole word sequence as its one shingle; null, empty or wordless texts have
    none and link with nothing. Equal sets count once and share a component. Rows that repeat an id and text are one
    document and give a row each; other rows of an id, and rows without one, are documents of their own (`documents`). A
    component is the smallest id among its documents, null if none has one. An empty table gives no rows; other columns
    are not read.
    """
    with small_batches(docs.sparkSession):
        known = documents(docs)
        found = _linked(known.rows, k, threshold, orders).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
        if known.again is None:
            return found
        found = materialise(found, few_files(docs))
        least = found.join(known.again, "doc_id").groupBy("component_id").agg(F.min("given").alias("_least"))
        numbers = known.again.where("given is null or given != doc_id").select(F.col("doc_id").alias("component_id"), F.lit(True).alias("_made"))
        own = F.when(F.col("_made").isNull(), F.col("component_id"))  # a number that we gave is no id
        found = found.join(least, "component_id", "left").join(numbers, "component_id", "left").select("doc_id", "n_shingles", F.least(own, "_least").alias("component_id"))
        return known.restore(found)


def distinct_documents(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), orders: int = 2) -> DataFrame:
    """One row of each group of linked rows, with all its columns: of the smallest id, and of rows that repeat it, one.

    Rows without words are no group and all stay, as they are. A group without any id keeps the row of the least MD5.
    """
    with small_batches(docs.sparkSession):
        files, known = few_files(docs), documents(docs)
        found = materialise(_linked(known.rows, k, threshold, orders), files)
        gone = found.where("n > 0 and doc_id != component").select("doc_id")
        if known.again is None:
            return by_id(docs, gone, "doc_id", "left_anti").select(*docs.columns)
        # What shares an id with others is told by its text: of what stays, any one of the equal rows.
        gone = gone.join(known.again, "doc_id", "left").select("doc_id", F.coalesce("given", F.when(F.col("times").isNull(), F.col("doc_id"))).alias("given"), F.col("times").isNotNull().alias("odd"))
        odd_ids = known.again.select(F.col("given").alias("doc_id")).where("doc_id is not null").distinct()
        plain = by_id(by_id(docs.where("doc_id is not null"), odd_ids, "doc_id", "left_anti"), gone.where("not odd").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
        shared = by_id(docs.where("doc_id is not null"), odd_ids, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
        key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
        shared = shared.select(F.col("doc_id").alias("id"), key.alias("key"), F.struct(*docs.columns).alias("row"))
        left = known.again.join(found.where("n = 0 or doc_id = component").select("doc_id", "n"), "doc_id")
        left = left.join(known.rows.select("doc_id", key.alias("md5")), "doc_id").select("given", "md5", "n")
        kept = shared.join(left, F.col("id").eqNullSafe(F.col("given")) & (F.col("key") == F.col("md5")))
        wordy = kept.where("n > 0").groupBy("id", "key").agg(F.first("row").alias("row"))
        return plain.union(kept.where("n = 0").select("row.*")).union(wordy.select("row.*"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
