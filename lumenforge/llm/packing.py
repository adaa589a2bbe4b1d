"""Best-fit packing by exact-complement hashing over a histogram of lengths."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import materialise, ranked, small_batches, table, trimmed

#: ASCII punctuation after a letter or digit is a token of its own (but for apostrophes): such words have their parts' ids.
ENDED = re.compile(rb"(.*[a-z0-9])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 250_000


class WordIds(dict):
    """Token ids (little-endian bytes) of the words of texts: the tokenizer drops white space and case.

    When the memory is full, it becomes the older generation, from which words in use come back.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.older = Tokenizer.from_file(path), {}
        self.direct = all(self.letters(w) == self.whole(w) for w in (b"a", b"the", b"internationalisation", b"qzxjkvwq", bytes(range(97, 123)) * 4))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None and self.direct and word.isalpha():
            found = self.letters(word)
        elif found is None and (parts := ENDED.fullmatch(word)):
            found = self[parts[1]] + self[parts[2]]
        elif found is None:
            found = self.whole(word)
        self[word] = found
        return found

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def letters(self, word: bytes) -> bytes:
        """The ids of a word of a-z alone, which is one piece as it stands: the model takes it without the steps before."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.decode())]).tobytes()

    def of(self, text: bytes) -> bytes:
        if b"<|" in text:  # it may hold the name of a special token
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """A worker keeps what it remembers from task to task."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


def piece_lengths(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, end = word_ids(tokenizer), b"\0\0\0\0"
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids = words.of(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    out.append((doc.as_py(), piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_fill(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every counted length exactly.

    First whole sequences, then pairs and triples that sum exactly to ``size`` (the complement is looked up in the
    counts), each as often as the counts allow; the residue goes best-fit, longest first, each into the fullest
    open pattern that takes it. Work depends on the number of different
    lengths only, never on the number of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    made: dict[tuple[int, ...], int] = defaultdict(int)

    def take(*parts: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        if times := min(int(left[p]) // c for p, c in need.items()):
            made[tuple(sorted(parts, reverse=True))] += times
            for p, c in need.items():
                left[p] -= times * c

    if left[size]:
        take(size)
    for a in range(size - 1, (size - 1) // 2, -1):
        if left[a] and left[size - a]:
            take(a, size - a)
    for a in range(size - 2, 0, -1):  # the longest first: they are the hardest to place
        rest = size - a
        while left[a]:
            b = np.arange(min(rest - 1, a), (rest - 1) // 2, -1)
            b = b[(left[b] > 0) & (left[rest - b] > 0)]
            b = b[(left[b] > (b == a)) & ((b != rest - b) | (left[b] > 1 + (b == a)))]
            if not len(b):
                break
            take(a, int(b[0]), int(rest - b[0]))
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    room = np.zeros(size + 1, np.int64)  # open patterns by the space left
    for a in range(size, 0, -1):
        while left[a]:
            fit = np.flatnonzero(room[a:])
            if len(fit):
                space = int(fit[0]) + a
                pattern, n = next(iter(open_[space].items()))
                times = min(n, int(left[a]))
                open_[space][pattern] -= times
                if n == times:
                    del open_[space][pattern]
                room[space] -= times
            else:
                each = size // a
                pattern, space, times = (), size, -(-int(left[a]) // each)
                if times > 1 and each > 1:  # whole sequences of this length, as best fit would fill them
                    times = int(left[a]) // each
                    pattern, space = (a,) * (each - 1), size - (each - 1) * a
                    left[a] -= times * (each - 1)
                else:
                    times = 1 if each > 1 else times
            open_[space - a][(*pattern, a)] += times
            room[space - a] += times
            left[a] -= times
    for patterns in open_.values():
        for p, n in patterns.items():
            made[p] += n
    return sorted(made.items(), reverse=True)


def pack_best_fit(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """Pack every piece of every document into sequences of at most ``size`` tokens.

    A document is its token ids and one end id 0; only longer ones are cut. The histogram of lengths (at most
    ``size`` numbers) goes to the driver, `plan_fill` makes patterns, and the k-th piece of a length takes the k-th
    place that the patterns have for it; ranks come from hash buckets, so that a hot length is no single task.
    A null or empty text is one piece of the end id; a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; other columns are not read.
    """
    with small_batches(docs.sparkSession):
        pieces = materialise(piece_lengths(docs, tokenizer, size))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, firsts, bases, offsets = [], [], [], []  # one row for each place of a pattern
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in plan_fill(counts, size):
        offset = 0
        for n in pattern:
            lengths.append(n)
            firsts.append(used[n])
            bases.append(sequence)
            offsets.append(offset)
            used[n] += times
            offset += n
        sequence += times
    order = np.lexsort((firsts, lengths)) if lengths else np.zeros(0, np.int64)
    keys, bases, offsets = ((np.array(lengths, np.int64) << 44) + np.array(firsts, np.int64))[order], np.array(bases, np.int64)[order], np.array(offsets, np.int64)[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = (b["length"].to_numpy() << 44) + b["_rank"].to_numpy()
            i = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(bases[i] + key - keys[i]), pa.array(offsets[i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    buckets = max(256, sum(counts.values()) // 50_000)  # of a length; they follow the number of pieces
    rows = ranked(pieces, ["length"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), ["doc_id", "piece", "ids_crc32"], "_rank")
    return rows.mapInArrow(trimmed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), default_tokenizer())
