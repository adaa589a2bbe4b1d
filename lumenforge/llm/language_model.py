"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

1. Workers count the pairs (previous word, word) of their training texts and deal the distinct ones of each chunk by the
   previous word's hash bucket (`_pack`). The pairs of words that are frequent in a sample (`frequent_words`) are dealt by
   the pair instead, so that no bucket holds all that follows a frequent word; what the sample says changes where counts
   are made, never the counts.
2. A bucket merges them, chunk by chunk, into its contexts (count, pairs seen once, twice, more often) and its pairs, and
   writes both as sorted arrays to the shared folder; the number of distinct predecessors of each word goes on to that
   word's bucket, which writes it likewise (`_contexts_and_pairs`, `_continuations`).
3. A few sums make the discounts. Scoring maps the arrays into memory and looks up the distinct words and pairs of some
   texts at a time; nothing is shuffled (`score_texts`).

Words are 64-bit hashes, and a pair is looked up by a 64-bit hash of both among those of its bucket, of which there are
some 40 million at 100 TB: an unseen pair is taken for a seen one about once in 10^11 lookups, whatever the input's size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import bucket_plan, chunks, delete_folder, joined, materialise, mix, plan_bytes, release, shared_folder, slices, small_batches, table, trimmed, word_hashes

#: Pairs that a worker counts at once, and pairs that a bucket should hold (see `bucket_plan`).
PACK, BUCKET = 400_000, 700_000
#: Rows that go to a Python worker at a time: a packed row can hold some 100,000 pairs.
BATCH = 64
#: Of a sample's tokens, the share from which a word's pairs are dealt one by one; bytes of the sample.
FREQUENT, SAMPLE_BYTES = 1e-3, 64 << 20
START, END = (np.uint64(x) for x in (0x5BD1E9955BD1E995, 0xC6A4A7935BD1E995))


def token_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, previous, token) of every word and of each text's end."""
    buf, at = joined(texts)
    words, starts, _ = word_hashes(buf)
    counts = np.bincount(np.searchsorted(at, starts, side="right") - 1, minlength=len(texts))
    row = np.repeat(np.arange(len(texts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    token = np.empty(len(row), np.uint64)
    inner = np.ones(len(row), bool)
    inner[last] = False
    token[inner], token[last] = words, END
    before = np.empty(len(row), np.uint64)
    before[1:] = token[:-1]
    before[last - counts] = START
    return row, before, token


def _cuts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)


def _summed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (v, w) in order with the sums of n."""
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    return v[first], w[first], np.add.reduceat(n, first) if len(first) else n


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of some (v, w, n), which are let go: the list is empty afterwards."""
    parts = [np.concatenate([h[i] for h in held]) for i in range(3)]
    held.clear()
    return _summed(*parts)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's hash."""
    return mix(mix(v * np.uint64(0x9FB21C651E98DF25)) + w)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x


def pair_bucket(v: np.ndarray, w: np.ndarray, bits: int, frequent: np.ndarray) -> np.ndarray:
    b = _bucket(v, bits)
    many = _among(v, frequent)
    b[many] = _bucket(pair_key(v[many], w[many]), bits)
    return b


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes, in order, of START and of words with a share of FREQUENT of the tokens of some documents; 2 / FREQUENT at most."""
    part = max(1, plan_bytes(docs) // SAMPLE_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], 0
        for _, texts in chunks(batches):
            token = token_pairs(texts)[2]
            seen += len(token)
            held.append(np.unique(token, return_counts=True))
            if len(held) > 32:
                w, _, n = _summed(np.concatenate([h[0] for h in held]), np.zeros(sum(len(h[0]) for h in held), np.uint8), np.concatenate([h[1] for h in held]))
                held = [(w, n)]
        w, _, n = _summed(np.concatenate([np.zeros(0, np.uint64), *(h[0] for h in held)]), np.zeros(sum(len(h[0]) for h in held), np.uint8), np.concatenate([np.zeros(0, np.int64), *(h[1] for h in held)]))
        often = (n >= seen * FREQUENT / 2) & (w != END)
        yield pa.RecordBatch.from_arrays([pa.array([None, *w[often].view(np.int64).tolist()], pa.int64()), pa.array([seen, *n[often].tolist()], pa.int64())], names=["w", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(part)) == 0) if part > 1 else docs
    counts = materialise(some.select("doc_id", "text").mapInArrow(trimmed(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))  # used twice
    total = counts.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rows = counts.where("w is not null").crossJoin(F.broadcast(total.withColumnRenamed("n", "of"))).where(F.col("n") >= F.col("of") * FREQUENT).select("w").collect()  # one row
    return np.unique(np.array([r.w for r in rows] + [np.int64(START.view(np.int64))], np.int64).view(np.uint64))


def _pack(docs: DataFrame, bits: int, pack: int, frequent: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            v, w = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            v, w, n = _summed(v, w, np.ones(len(v), np.int64))
            b = pair_bucket(v, w, bits, frequent)
            order = np.argsort(b, kind="stable")
            v, w, n, b = v[order], w[order], n[order], b[order]
            at = _cuts(b)
            out = []
            for i, j in zip(at, [*at[1:], len(b)], strict=True):
                s = _cuts(v[i:j])
                lens = np.diff(np.concatenate((s, [j - i]))).astype("<u4")
                out.append((int(b[i]), v[i:j][s].tobytes(), lens.tobytes(), w[i:j].tobytes(), _least(n[i:j]).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "v", "lens", "w", "n"])

        for _, texts in chunks(batches):
            _, before, token = token_pairs(texts)
            held.append((before, token))
            size += len(token)
            if size >= pack:
                yield flush()
                held, size = [], 0
                release()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "bucket int, v binary, lens binary, w binary, n binary")


def _filesystem(folder: str):
    from pyarrow import fs

    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file:///") else folder
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its final name in one move, so that a task that runs twice leaves one whole file."""
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        np.save(out, array)
    files.move(part, f"{path}/{name}.npy")


def _least(n: np.ndarray) -> np.ndarray:
    return n.astype(np.min_scalar_type(int(n.max()) if len(n) else 0))


SUMS = [f"{x}{i}" for x in ("pairs", "words") for i in range(1, 5)]
STATS = ("total", "once", "twice", "more")
COUNTED = f"bucket int, w binary, n binary, tokens long, types long, distinct long, {', '.join(f'{s} long' for s in SUMS)}, frequent long, {', '.join(f'{s} long' for s in STATS)}"


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in range(1, 5)]


def _contexts_and_pairs(packed: DataFrame, parts: int, bits: int, folder: str, frequent: np.ndarray) -> DataFrame:
    """Writes each bucket's contexts and pairs; gives its sums, by bucket of the second word predecessor counts, and of each
    task the statistics of the frequent words' pairs that it has met."""

    def finish(bucket: int, v: np.ndarray, w: np.ndarray, n: np.ndarray, common: np.ndarray) -> list[tuple]:
        at = _cuts(v)
        stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n > 2)], axis=1)
        many = _among(v[at], frequent)
        common[np.searchsorted(frequent, v[at][many])] += stats[many]
        _save(folder, f"word-{bucket}-hash", v[at][~many])
        _save(folder, f"word-{bucket}-stats", _least(stats[~many]))
        key = pair_key(v, w)
        order = np.argsort(key, kind="stable")
        _save(folder, f"pair-{bucket}-key", key[order])
        _save(folder, f"pair-{bucket}-n", _least(n[order]))
        out: list[tuple] = [(None, None, None, int(n.sum()), int((~many).sum()), len(v), *_of_counts(n), *[0] * 4, None, *[0] * 4)]
        seen, times = np.unique(w, return_counts=True)
        b = _bucket(seen, bits)
        cut = _cuts(b)
        out += [(int(b[i]), seen[i:j].tobytes(), times[i:j].astype("<u4").tobytes(), *[0] * 11, None, *[0] * 4) for i, j in zip(cut, [*cut[1:], len(b)], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        common = np.zeros((len(frequent), 4), np.int64)

        def finished() -> pa.RecordBatch:
            done = batch_of(finish(at, *_merged(held), common))
            release()
            return done

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 16), strict=True)], names=["bucket", "w", "n", "tokens", "types", "distinct", *SUMS, "frequent", *STATS])

        for batch in slices(batches, 16):
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    if held:
                        yield finished()
                    at, held, size = r["bucket"], [], 0
                v = np.repeat(np.frombuffer(r["v"], "<u8"), np.frombuffer(r["lens"], "<u4").astype(np.int64))
                held.append((v, np.frombuffer(r["w"], "<u8"), np.frombuffer(r["n"], f"<u{len(r['n']) // len(v)}").astype(np.int64)))
                size += len(v)
                if size > 2 * BUCKET and len(held) > 1:
                    held.append(_merged(held))
                    size = len(held[0][0]) // 2  # what is distinct counts half: merge again when as much has come on top
        if held:
            yield finished()
        met = np.flatnonzero(common[:, 0])
        if len(met):
            yield batch_of([(None, None, None, *[0] * 11, h, *c) for h, c in zip(frequent[met].view(np.int64).tolist(), common[met].tolist(), strict=True)])

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), COUNTED)


def _continuations(counted: DataFrame, parts: int, folder: str) -> DataFrame:
    """Writes for each word how many distinct words precede it; gives sums for the discounts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def finish() -> pa.RecordBatch:
            w, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            w, _, n = _summed(w, np.zeros(len(w), np.uint8), n)
            _save(folder, f"after-{at}-key", w)
            _save(folder, f"after-{at}-n", _least(n))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in _of_counts(n)], names=SUMS[4:])

        for batch in slices(batches, 64):
            for r in batch.to_pylist():
                if r["bucket"] != at:
                    if held:
                        yield finish()
                    at, held = r["bucket"], []
                held.append((np.frombuffer(r["w"], "<u8"), np.frombuffer(r["n"], "<u4").astype(np.int64)))
                if len(held) > 512:
                    w, _, n = _summed(np.concatenate([h[0] for h in held]), np.zeros(sum(len(h[0]) for h in held), np.uint8), np.concatenate([h[1] for h in held]))
                    held = [(w, n)]
        if held:
            yield finish()

    rows = counted.where("bucket is not null").select("bucket", "w", "n")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), ", ".join(f"{s} long" for s in SUMS[4:]))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more; plain ones where the counts of counts give none."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


@dataclass
class Model:
    """Where the arrays are, and the numbers that the driver holds."""

    folder: str
    bits: int
    tokens: int  # training tokens, ends included
    types: int  # distinct ones
    texts: int
    distinct: int  # distinct pairs
    pair: tuple[float, float, float]
    word: tuple[float, float, float]
    left: float  # what discounting leaves for words as yet unseen
    frequent: np.ndarray  # hashes of the words whose pairs are dealt one by one, and the statistics of their pairs
    common: np.ndarray

    def arrays(self) -> Arrays:
        return Arrays(self)


class Arrays:
    """A worker's view of the model: arrays mapped when first needed."""

    def __init__(self, model: Model):
        self.m, self.held = model, {}
        self.files, self.path = _filesystem(model.folder)

    def get(self, name: str) -> np.ndarray | None:
        if name not in self.held:
            from pyarrow import fs

            path = f"{self.path}/{name}.npy"
            if self.files.get_file_info(path).type == fs.FileType.NotFound:
                self.held[name] = None
            elif isinstance(self.files, fs.LocalFileSystem):
                self.held[name] = np.load(path, mmap_mode="r")
            else:  # a store that can't be mapped
                with self.files.open_input_file(path) as f:
                    self.held[name] = np.load(f)
        return self.held[name]

    def look(self, kind: str, key: str, value: str, bucket: np.ndarray, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of keys (0 where there is none); buckets must be in order."""
        out = np.zeros((len(keys), width), np.int64)
        at = _cuts(bucket)
        for i, j in zip(at, [*at[1:], len(bucket)], strict=True):
            held = self.get(f"{kind}-{bucket[i]}-{key}")
            if held is None or not len(held):
                continue
            k = np.minimum(np.searchsorted(held, keys[i:j]), len(held) - 1)
            hit = held[k] == keys[i:j]
            out[i:j][hit] = self.get(f"{kind}-{bucket[i]}-{value}")[k[hit]].reshape(-1, width)
        return out

    def probabilities(self, words: np.ndarray, prior: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how often each word was seen, the probability of each pair), pairs as places in the sorted distinct ``words``."""
        m = self.m
        bucket = _bucket(words, m.bits)
        stats = self.look("word", "hash", "stats", bucket, words, 4)
        many = _among(words, m.frequent)
        stats[many] = m.common[np.searchsorted(m.frequent, words[many])]
        count = np.where(words == START, 0, np.where(words == END, m.texts, stats[:, 0]))
        after = self.look("after", "key", "n", bucket, words)[:, 0]
        d, e = np.array((0.0, *m.pair)), np.array((0.0, *m.word))
        lower = (after - e[np.minimum(after, 3)]) / max(1, m.distinct) + m.left / (m.types + 1)
        total = np.maximum(stats[:, 0], 1)
        weight = np.where(stats[:, 0] > 0, (stats[:, 1:] @ d[1:]) / total, 1.0)
        pairs, which = np.unique(prior.astype(np.int64) * len(words) + own, return_inverse=True)
        v, w = pairs // len(words), pairs % len(words)
        key = pair_key(words[v], words[w])
        held = pair_bucket(words[v], words[w], m.bits, m.frequent)
        order = np.lexsort((key, held))
        n = np.zeros(len(pairs), np.int64)
        n[order] = self.look("pair", "key", "n", held[order], key[order])[:, 0]
        return count, (np.maximum(n - d[np.minimum(n, 3)], 0) / total[v] + weight[v] * lower[w])[which]

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        m, size = self.m, len(texts)
        row, before, token = token_pairs(texts)
        words, where = np.unique(np.concatenate((token, before)), return_inverse=True)
        own, prior = where[: len(token)], where[len(token) :]
        count, p = self.probabilities(words, prior, own)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.types + 1)))[own]
        sums = lambda x: np.bincount(row, weights=x, minlength=size)
        return np.bincount(row, minlength=size), sums((count > 0)[own]).astype(np.int64), sums(base), sums(np.log10(p))


def train(docs: DataFrame) -> Model:
    """Counts all texts of ``docs`` (null: empty) and writes the model to the session's shared folder, where it stays until
    `delete_folder` removes it."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    pack, bits = bucket_plan(plan_bytes(docs) / 4, PACK, BUCKET)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frequent = frequent_words(docs)
    counted = materialise(_contexts_and_pairs(_pack(docs, bits, pack, frequent), parts, bits, folder, frequent))
    a = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "distinct", *SUMS[:4]))).first()
    common = np.zeros((len(frequent), 4), np.int64)
    for r in counted.where("frequent is not null").groupBy("frequent").agg(*(F.sum(c).alias(c) for c in STATS)).collect():  # 2 / FREQUENT rows at most
        common[np.searchsorted(frequent, np.array([r.frequent]).view(np.uint64))] = [[r[c] for c in STATS]]
    b = _continuations(counted, parts, folder).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS[4:]), F.lit(0)).first()
    texts = docs.count()
    words = discounts(*(b[s] for s in SUMS[4:]))
    types = a["types"] + int(((common[:, 0] > 0) & (frequent != START)).sum()) + (texts > 0)
    once, twice = b["words1"], b["words2"]
    left = (words[0] * once + words[1] * twice + words[2] * max(0, types - once - twice)) / max(1, a["distinct"]) if a["distinct"] else 1.0
    return Model(folder, bits, a["tokens"], types, texts, a["distinct"], discounts(*(a[s] for s in SUMS[:4])), words, left, frequent, common)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = model.arrays()
        for ids, texts in chunks(batches):
            n, known, base, score = arrays.scores(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), model.tokens, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def remainder(column: str, by: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by)), F.lit(0))


def kneser_ney_scores(docs: DataFrame) -> DataFrame:
    """Scores of every document by a model of those whose crc32(doc_id) mod 5 is not 1.

    Null and empty texts are one end token; repeated rows count and are scored each; a row without an id is learned from
    and scored under a null id; an empty table gives no rows; other columns are not read. The scores are kept as a
    checkpoint and the model is deleted.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with small_batches(spark, BATCH):
        model = train(docs.where(remainder("doc_id", 5) != 1))
        scores = materialise(score_texts(docs, model))
        delete_folder(spark, model.folder)
    return scores.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney_scores(table(spark, sf_dir, "documents"))
