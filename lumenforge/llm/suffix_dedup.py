"""Repeated passages by common-prefix interval trees over sparse enhanced suffix arrays.

1. Every window of ``length`` bytes holds one anchor: the position whose GRAM-byte hash is least in it, leftmost of
   equals. Equal windows hold equal anchors at equal places, so suffixes need sorting only where anchors stand, and
   only in groups of equal anchor hashes (`anchors`, `_pack`, `_repeated`).
2. An anchor that stands in one place only can't be in a repeat. The others send the bytes around them to the task of
   their hash (`_contexts`).
3. There each group is an enhanced suffix array: suffixes at the anchors, sorted, with their common prefixes. A stack
   scan gives its interval tree; in each interval a second scan over the reversed left contexts gives the sets that
   share a longer left side too. A set whose left extensions and right extensions both differ is a maximal repeat,
   with all its occurrences (`Group`).
4. To remove repeats, contexts need to reach no further than one window. To give every maximal repeat whole, windows
   and contexts double from level to level, for the documents that hold longer ones (`maximal_repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import CHUNK_BYTES, bucket_plan, by_id, chunks, documents, few_files, materialise, mix, plan_bytes, powers, slices, small_batches, table, trimmed

LENGTH, GRAM = 100, 32
#: Anchors that a worker packs at once, anchors that a bucket should hold (see `bucket_plan`), contexts that are sorted together.
PACK, BUCKET, TOGETHER = 200_000, 300_000, 10_000
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8BB84B93962EACC9))
_POSITION = np.uint64((1 << 24) - 1)
_SECTION = 1 << 22


def _grams(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position (of what there is, at the end)."""
    base = 0x2545F4914F6CDD1D
    total = np.zeros(len(buf) + gram, np.uint64)
    np.cumsum(_BYTES[buf] * powers(base, len(buf))[: len(buf)], out=total[1 : len(buf) + 1])
    total[len(buf) + 1 :] = total[len(buf)]
    return mix((total[gram:] - total[:-gram]) * powers(pow(base, -1, 1 << 64), len(buf))[: len(buf)])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of the anchors of every window of ``length`` bytes of every text."""
    rows, places, hashes = [], [], []

    def of(parts: list[bytes], row: np.ndarray, base: np.ndarray) -> None:
        buf = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        if len(buf) < length:
            return
        h = _grams(buf, gram)
        key = (h & ~_POSITION) | np.arange(len(buf), dtype=np.uint64)
        span, n = length - gram + 1, 1
        while 2 * n <= span:
            key = np.minimum(key[:-n], key[n:])
            n *= 2
        if span > n:
            key = np.minimum(key[: len(key) - (span - n)], key[span - n :])
        valid = np.zeros(len(buf) + 1, np.int8)  # windows that end within their text
        whole = sizes >= length
        np.add.at(valid, starts[whole], 1)
        np.add.at(valid, (starts + sizes - length + 1)[whole], -1)
        key = key[np.cumsum(valid[: len(key)]) > 0]
        at = np.unique((key & _POSITION).astype(np.int64))
        part = np.searchsorted(starts, at, side="right") - 1
        rows.append(row[part])
        places.append(at - starts[part] + base[part])
        hashes.append(mix(h[at]))  # least values are far from uniform; buckets need uniform ones

    parts, row, base, held = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), _SECTION):
            parts.append(t[a : a + _SECTION + length - 1])
            row.append(i)
            base.append(a)
            held += len(parts[-1])
            if held > _SECTION:
                of(parts, np.array(row), np.array(base))
                parts, row, base, held = [], [], [], 0
    if parts:
        of(parts, np.array(row), np.array(base))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, place, h = (np.concatenate(x) for x in (rows, places, hashes))
    if max(map(len, texts)) > _SECTION:  # sections overlap
        (row, place), i = np.unique(np.stack((row, place)), axis=1, return_index=True)
        h = h[i]
    return row, place, h


def _cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cut)) if len(keys) else cut, np.concatenate((cut, [len(keys)])) if len(keys) else cut


def _pack(docs: DataFrame, length: int, gram: int, bits: int, pack: int) -> DataFrame:
    """Anchors by hash bucket: the counts of a chunk's distinct hashes (kind 0), and its anchors by document (kind 1)."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        doc, place, h = (np.concatenate([x[i] for x in held]) for i in range(3))
        bucket = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
        order = np.argsort(bucket, kind="stable")
        doc, place, h, bucket = doc[order], place[order], h[order], bucket[order]
        out: list[tuple] = []
        chunk = int.from_bytes(hashlib.md5(doc.tobytes()).digest()[:7])
        for a, b in zip(*_cuts(bucket), strict=True):
            uniq, n = np.unique(h[a:b], return_counts=True)
            out.append((int(bucket[a]), 0, None, None, None, None, uniq.tobytes(), n.astype("<u4").tobytes()))
            s, e = _cuts(doc[a:b])
            out.append((int(bucket[a]), 1, chunk, doc[a:b][s].tobytes(), (e - s).astype("<u4").tobytes(), place[a:b].astype("<u4").tobytes(), h[a:b].tobytes(), None))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=["bucket", "kind", "chunk", "docs", "lens", "places", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, texts in chunks(batches, CHUNK_BYTES):
            row, place, h = anchors(texts, length, gram)
            held.append((ids[row], place, h))
            n += len(h)
            if n >= pack:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "bucket int, kind int, chunk long, docs binary, lens binary, places binary, hashes binary, counts binary")


def _repeated(packed: DataFrame, parts: int) -> DataFrame:
    """(doc_id, places, hashes) of the anchors that stand in several places; a bucket holds its distinct hashes only.

    Buckets answer a chunk in one row each, and a chunk's answers meet again by document.
    """

    def merge(counts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([c[0] for c in counts])
        order = np.argsort(h, kind="stable")
        h, n = h[order], np.concatenate([c[1] for c in counts])[order]
        first, _ = _cuts(h)
        return h[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, often, held = -1, [], None, 0
        for batch in slices(batches, 64):
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    at, counts, often, held = r["bucket"], [], None, 0
                h = np.frombuffer(r["hashes"], "<u8")
                if r["kind"] == 0:
                    counts.append((h, np.frombuffer(r["counts"], "<u4").astype(np.int64)))
                    held += len(h)
                    if held > 2 * BUCKET and len(counts) > 1:
                        counts = [merge(counts)]
                        held = len(counts[0][0]) // 2  # merge again when as much has come on top
                    continue
                if often is None:
                    keys, n = merge(counts)
                    often, counts = keys[n > 1], []
                if not len(often):
                    continue
                hit = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h
                docs = np.repeat(np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["lens"], "<u4").astype(np.int64))[hit]
                out.append((r["chunk"], docs.tobytes(), np.frombuffer(r["places"], "<u4")[hit].tobytes(), h[hit].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["chunk", "docs", "places", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def by_doc() -> pa.RecordBatch:
            doc, place, h = (np.frombuffer(b"".join(r[c] for r in held), t) for c, t in (("docs", "<i8"), ("places", "<u4"), ("hashes", "<u8")))
            order = np.argsort(doc, kind="stable")
            doc, place, h = doc[order], place[order], h[order]
            out = [(int(doc[a]), place[a:b].tobytes(), h[a:b].tobytes()) for a, b in zip(*_cuts(doc), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "places", "hashes"])

        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if r["chunk"] != at:
                    if held:
                        yield by_doc()
                    at, held = r["chunk"], []
                held.append(r)
        if held:
            yield by_doc()

    replies = packed.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(trimmed(run), "chunk long, docs binary, places binary, hashes binary")
    return replies.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(trimmed(meet), "doc_id long, places binary, hashes binary")


CONTEXT = "hash long, doc_id long, place long, left binary, right binary, copies long"
_NAMES = ["hash", "doc_id", "place", "left", "right", "copies"]
#: Distinct contexts that a worker holds to find equal ones before they are sent.
HELD = 50_000


def _around(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each document that holds repeated anchors, with its text and their places."""
    grouped = found.groupBy("doc_id").agg(F.collect_list("places").alias("places"), F.collect_list("hashes").alias("hashes"))
    return by_id(docs.select("doc_id", "text"), found.select("doc_id").distinct(), "doc_id", "left_semi").join(grouped, "doc_id")


def _contexts(docs: DataFrame, found: DataFrame, length: int, gram: int) -> DataFrame:
    """What one window can reach on either side of each repeated anchor: (hash, doc_id, place, left, right, copies).

    Of equal contexts of a task only the earliest is sent, with their number. The others are repeats as far as the
    context goes; they are answered as rows without ``left``, whose ``hash`` spreads them and whose ``copies`` is the length of
    the repeat from ``place``. So a passage that a large share of all texts hold comes to one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes, bytes], list[int]] = {}

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (*[pa.int64()] * 3, *[pa.binary()] * 2, pa.int64()), strict=True)], names=_NAMES)

        def sent() -> Iterator[pa.RecordBatch]:
            rows = [(h, doc, place, left, right, n) for (h, left, right), (doc, place, n) in held.items()]
            held.clear()
            for i in range(0, len(rows), 5_000):
                yield batch_of(rows[i : i + 5_000])

        for batch in slices(batches, 4):
            out: list[tuple] = []
            for doc, text, places, hashes in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["places"].to_pylist(), batch["hashes"].to_pylist(), strict=True):
                for p, h in zip(np.frombuffer(b"".join(places), "<u4").tolist(), np.frombuffer(b"".join(hashes), "<i8").tolist(), strict=True):
                    left, right = text[max(0, p - length + gram) : p], text[p : p + length]
                    first = held.setdefault((h, left, right), [doc, p, 0])
                    first[2] += 1
                    if first[2] > 1:
                        late = (doc, p)
                        if late < (first[0], first[1]):
                            late, first[:2] = (first[0], first[1]), late
                        out.append((late[0], late[0], late[1] - len(left), None, None, len(left) + len(right)))
            for i in range(0, len(out), 5_000):
                yield batch_of(out[i : i + 5_000])
            if len(held) > HELD:
                yield from sent()
        yield from sent()

    return _around(docs, found).mapInArrow(trimmed(run), CONTEXT)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan: (length, first, last) of every interval of a sorted array, ``common[i]`` shared by i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        now, first = (common[i] if i < len(common) else 0), i - 1
        while now < stack[-1][0]:
            n, first = stack.pop()
            yield n, first, i - 1
        if now > stack[-1][0]:
            stack.append((now, first))


def _sorted_common(group: np.ndarray, side: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and bytes, and how many bytes each shares with the one before it (0 across groups)."""
    key = np.zeros((len(side), 8 + side.shape[1]), np.uint8)
    key[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, 8:] = side
    order = np.argsort(key.view(f"V{key.shape[1]}").ravel(), kind="stable")
    return order, shared_bytes(side, lens, order, group)


def shared_bytes(side: np.ndarray, lens: np.ndarray, order: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        differ = side[a] != side[b]
        n = np.where(differ.any(1), differ.argmax(1), side.shape[1])
        out[1:] = np.minimum(n, np.minimum(lens[a], lens[b]))
        if group is not None:
            out[1:][group[a] != group[b]] = 0
    return out


class Group:
    """Distinct contexts of some anchors in the order in which they stand, each with what ``where`` tells of it."""

    def __init__(self, length: int, left: int, right: int):
        self.length, self.reach, self.ahead = length, left, right
        self.number, self.where, self.left, self.right = [], [], [], []

    def add(self, number: int, where: object, left: bytes, right: bytes) -> None:
        self.number.append(number)
        self.where.append(where)
        self.left.append(left)
        self.right.append(right)

    def sets(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left length, right length, members) of every maximal repeat of at least ``length`` bytes, as far as contexts reach."""
        m = len(self.number)
        group = np.array(self.number, np.int64)
        lens_l, lens_r = (np.array([len(x) for x in s], np.int64) for s in (self.left, self.right))
        left = np.frombuffer(b"".join([x[::-1].ljust(self.reach, b"\0") for x in self.left]), np.uint8).reshape(m, self.reach)
        right = np.frombuffer(b"".join([x.ljust(self.ahead, b"\0") for x in self.right]), np.uint8).reshape(m, self.ahead)
        by_left, _ = _sorted_common(group, left, lens_l)
        rank = np.empty(m, np.int64)
        rank[by_left] = np.arange(m)
        order, common = _sorted_common(group, right, lens_r)
        for a, b in zip(*_cuts(group[order]), strict=True):
            if b - a < 2:
                continue
            array, prefix = order[a:b], common[a:b].copy()
            prefix[0] = 0
            for n, first, last in intervals(prefix.tolist()):
                if n < self.length - self.reach:
                    continue
                members = array[first : last + 1]
                inner = np.argsort(rank[members], kind="stable")
                mine = members[inner]
                shared = shared_bytes(left, lens_l, mine)
                found = list(intervals(shared.tolist()))
                if n >= self.length and not any(x[1] == 0 and x[2] == len(mine) - 1 for x in found):
                    found.append((0, 0, len(mine) - 1))
                for k, i, j in found:
                    if k + n < self.length:
                        continue
                    at = inner[i : j + 1]
                    lo, hi = int(at.min()), int(at.max())
                    if int(prefix[first + lo + 1 : first + hi + 1].min()) == n:  # else a longer repeat on the right
                        yield k, n, mine[i : j + 1]


def _covered(contexts: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """(doc_id, start, end): what repeats around an anchor remove.

    Occurrences come in order, so the first of equal contexts is the earliest; later ones are repeats as far as the
    context goes, and are answered at once, never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, at, number = Group(length, length - gram, length), {}, None, 0

        def finish() -> list[tuple]:
            out: list[tuple] = []
            if len(held.number) > 1:
                widest = np.zeros((len(held.where), 2), np.int64)
                for k, n, members in held.sets():
                    later = members[members != members.min()]
                    widest[later] = np.maximum(widest[later], (k, n))
                out = [(d, p - k, p + n) for (d, p), (k, n) in zip(held.where, widest.tolist(), strict=True) if n]
            held.__init__(length, length - gram, length)
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], names=["doc_id", "start", "end"])

        for batch in slices(batches, 2048):
            out: list[tuple] = []
            for h, doc, place, left, right, copies in zip(*(batch[c].to_pylist() for c in _NAMES), strict=True):
                if left is None:  # a later one of equal contexts of a task
                    if copies >= length:
                        out.append((doc, place, place + copies))
                    continue
                if h != at:
                    if len(held.number) > TOGETHER:
                        out += finish()
                    at, number, seen = h, number + 1, set()
                if (left, right) in seen:
                    if len(left) + len(right) >= length:
                        out.append((doc, place - len(left), place + len(right)))
                    continue
                seen.add((left, right))
                held.add(number, (doc, place), left, right)
            if out:
                yield batch_of(out)
        yield batch_of(finish())

    return contexts.repartition(parts, "hash").sortWithinPartitions("hash", "doc_id", "place").mapInArrow(trimmed(run), "doc_id long, start long, end long")


def _occurrences(docs: DataFrame, found: DataFrame, left: int, right: int) -> DataFrame:
    """(hash, doc_id, place, left, right, like) of every repeated anchor; ``like`` names its context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (*[pa.int64()] * 3, *[pa.binary()] * 2)
        for batch in slices(batches, 1):
            text = batch["text"].cast(pa.binary())[0].as_py()
            places, hashes = (np.frombuffer(b"".join(batch[c][0].as_py()), t).tolist() for c, t in (("places", "<u4"), ("hashes", "<i8")))
            step = max(1, (1 << 22) // (left + right))
            for i in range(0, len(places), step):
                out = [(h, batch["doc_id"][0].as_py(), p, text[max(0, p - left) : p], text[p : p + right]) for p, h in zip(places[i : i + step], hashes[i : i + step], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=_NAMES[:5])

    like = F.md5(F.concat(F.col("hash").cast("string").cast("binary"), F.lit(b":"), F.octet_length("left").cast("string").cast("binary"), F.lit(b":"), "left", "right"))
    return _around(docs, found).mapInArrow(trimmed(run), "hash long, doc_id long, place long, left binary, right binary").withColumn("like", like)


def _sets(contexts: DataFrame, parts: int, length: int, left: int, right: int) -> DataFrame:
    """(repeat, length, before, like): the sets of distinct contexts that share a maximal repeat, ``before`` bytes of it
    ahead of the anchor. What reaches the end of a context on the right comes with a null name: it is longer than seen here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, number, size = Group(length, left, right), None, 0, 0

        def finish() -> pa.RecordBatch:
            out: list[tuple] = []
            if len(held.number) > 1:
                for k, n, members in held.sets():
                    if k == left:  # longer on the left: its first anchor finds it
                        continue
                    one = members[0]
                    name = None if n == right else hashlib.md5(held.left[one][len(held.left[one]) - k :] + held.right[one][:n]).hexdigest()
                    out += [(name, k + n, k, like) for like in {held.where[i] for i in members.tolist()}]
            held.__init__(length, left, right)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["repeat", "length", "before", "like"])

        for batch in slices(batches, 64):
            for h, like, before, after, times in zip(*(batch[c].to_pylist() for c in ("hash", "like", "left", "right", "times")), strict=True):
                if h != at:
                    if size > (1 << 23):
                        yield finish()
                        size = 0
                    at, number = h, number + 1
                for _ in range(min(times, 2)):  # what stands twice with one context shares all of it
                    held.add(number, like, before, after)
                size += len(before) + len(after)
        yield finish()

    return contexts.repartition(parts, "hash").sortWithinPartitions("hash", "like").mapInArrow(trimmed(run), "repeat string, length long, before long, like string")


def _distinct(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, copy): whether an earlier document has the same text."""
    keys = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("key"))
    firsts = keys.groupBy("key", "n_bytes").agg(F.min("doc_id").alias("first"))
    return keys.join(firsts, ["key", "n_bytes"]).select("doc_id", "n_bytes", (F.col("doc_id") != F.col("first")).alias("copy"))


def _parts(docs: DataFrame) -> int:
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    pack, bits = bucket_plan(plan_bytes(docs) / 16, PACK, BUCKET)
    return materialise(_repeated(_pack(docs, length, gram, bits, pack), _parts(docs)), few_files(docs))


def _level(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The maximal repeats of ``length`` to twice as many bytes with all their occurrences; the documents with longer ones.

    A repeat of that length holds the anchor of its first window less than ``length - gram`` bytes after its start. Equal
    contexts are analysed as one, and their occurrences are joined to the sets that they are in afterwards.
    """
    files, left, right = few_files(docs), length - gram + 1, 2 * length
    around = _occurrences(docs, _anchored(docs, length, gram), left, right)
    each = materialise(around.select("like", "doc_id", "place"), files)
    distinct = around.groupBy("like").agg(F.first("hash").alias("hash"), F.first("left").alias("left"), F.first("right").alias("right"), F.count(F.lit(1)).alias("times"))
    sets = materialise(_sets(distinct, _parts(docs), length, left, right).distinct(), files)
    placed = sets.join(each, "like")
    found = placed.where(f"repeat is not null and length < {2 * length}").select("repeat", "length", "doc_id", (F.col("place") - F.col("before")).alias("start")).distinct()
    return materialise(found, files), materialise(placed.where(f"length >= {2 * length}").select("doc_id").distinct(), files)


def maximal_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(repeat, length, doc_id, start): every maximal repeat of at least ``length`` bytes with all its occurrences.

    A repeat is a byte string that stands in two places or more and can't be made longer on either side without losing
    one. Level s finds those of ``length`` x 2^s to twice that many bytes: anchors are the least of windows of
    ``length`` x 2^s bytes, so they get sparser as contexts get longer, and a level looks only at documents in which the
    one before met a repeat that is too long for it. Null and empty texts hold none; rows that repeat an id and text
    are one document, other rows of an id and rows without one are documents of their own (`documents`), which come
    back under the id that they had; an empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        known = documents(docs)
        rows, span, out = known.rows, length, None
        while True:
            part, longer = _level(rows, span, max(1, min(GRAM, span // 2)))
            out = part if out is None else out.union(part)
            if longer.isEmpty():
                return known.restore(out)
            rows, span = by_id(known.rows, longer, "doc_id", "left_semi"), 2 * span


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each text without the bytes of ``length``-byte strings that
    also start earlier (in a smaller doc_id, or earlier in the same text), judged on the input.

    A null text counts as empty; shorter texts lose nothing. Rows that repeat an id and text are one document, and each
    gives its row. Of different texts under one id the one of least MD5 stands at the id's place; the others, and texts
    without an id, come after all ids, in the order of (id, MD5), and give their rows too. An empty table gives no rows;
    other columns are not read.
    """
    with small_batches(docs.sparkSession):
        known = documents(docs)
        rows = known.rows
        info = materialise(_distinct(rows), few_files(docs))
        copies = info.where("copy").where(F.col("n_bytes") >= length)
        single = by_id(rows, copies.select("doc_id"), "doc_id", "left_anti")
        spans = materialise(_covered(_contexts(single, _anchored(single, length, GRAM), length, GRAM), _parts(docs), length, GRAM).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), few_files(docs))
        touched = spans.select("doc_id")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64):
                out: list[tuple] = []
                for doc, text, found in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
                    kept, at, merged = hashlib.sha256(), 0, []
                    for s in found:
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["start"], s["end"]])
                    for a, b in merged:
                        kept.update(text[at:a])
                        at = b
                    kept.update(text[at:])
                    out.append((doc, len(text), sum(b - a for a, b in merged), len(merged), kept.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (*[pa.int64()] * 4, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        # a task for each 64 MB of input, as `few_files` has it: the number of tasks follows the input
        changed = by_id(single, touched, "doc_id", "left_semi").join(spans, "doc_id").coalesce(few_files(docs)).mapInArrow(trimmed(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        zero = F.lit(0).cast("long")
        whole = by_id(single, touched, "doc_id", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
        gone = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
        return known.restore(changed.union(whole).union(gone))


def op8_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
