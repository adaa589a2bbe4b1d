"""Benchmark decontamination by typed templates: windows of canonical units, joined by hash, with consistent slots.

1. A text becomes units (`units`). A numeric expression (3.5, 1,200, 2/3, twenty-five, 5 million) is one NUMBER, a unit of
   measure after a number UNIT, a run of capitalised words one NAME, so that a value written in more or fewer tokens
   moves nothing else. A second form has no names, for passages in which capitals tell nothing.
2. Items are cut into windows of units, hashed as templates (`item_windows`). A bit map of fixed size tells workers which
   windows of documents may match any of them (`window_filter`), and Spark joins those that may with the items' windows
   by hash (`contaminated`). Nothing but that map and a count goes through the driver.
3. Windows of one document and item on one diagonal make a passage; its longest stretch in which each of the item's
   values maps to one value only is measured (`_stretches`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import CHUNK_BYTES, LOWER, by_id, chunks, few_files, free_name, joined, materialise, mix, slices, small, small_batches, table, trimmed, word_hashes

# Units of measure, and number words.
UNITS = """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce
ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year
years dollar dollars cent cents euro euros percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million dozen""".split()
#: Window length in units, literal units that a window needs, and windows in a row that make a passage.
WINDOW, LITERALS, RUN = 8, 5, 3
#: Bits of the map of the items' window hashes (8 MB), and windows of items that may be broadcast to a join.
FILTER_BITS, BROADCAST_WINDOWS = 26, 100_000
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x9D2C5680F1A7B3C1, 0xEFC60000A1B2C3D5, 0xB5026F5AA96619E9))
#: Forms: names as slots, without names, and the values themselves (for items with few literal units).
NAMED, PLAIN, VERBATIM = 0, 1, 2

#: Tokens are runs of letters and digits; every other ASCII character parts them.
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars]] = True
    return out


_DIGIT, _WITHIN, _BETWEEN = _bytes(b"0123456789"), _bytes(b".,:/"), _bytes(b" -'\n\t")


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8), _PARTS, LOWER)[0])


_UNITS, _NUMBERS = _hashes_of(UNITS), _hashes_of(NUMBER_WORDS)


def _in(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x if len(held) else np.zeros(len(x), bool)


def _lower(text: bytes) -> bytes:
    """Lower case of the same length; letters whose lower case is longer or shorter stay."""
    if text.isascii():
        return text.lower()
    low = text.decode().lower().encode()
    return low if len(low) == len(text) else b"".join(c.lower().encode() if len(c.lower().encode()) == len(c.encode()) else c.encode() for c in text.decode())


def _merged(row: np.ndarray, token: np.ndarray, own: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One unit for each run of tokens that join the one before; its value is the hash of all their values."""
    begins = np.flatnonzero(~joins)
    value = own[begins].copy()
    inner = np.flatnonzero(joins)
    if len(inner):
        unit = np.cumsum(~joins)[inner] - 1
        depth = inner - begins[unit]
        for k in range(1, int(depth.max()) + 1):
            at = depth == k
            value[unit[at]] = mix(value[unit[at]] * np.uint64(0xBF58476D1CE4E5B9) + own[inner[at]])
    return row[begins], token[begins], value


def units(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each form (row, canonical unit, value): NAMED and PLAIN. Literal units are their own value.

    What holds a digit or is a number word is a number; parts joined by one of ``.,:/`` between digits, and number words
    after a space or hyphen, go on with it. Capitalised words are names in the first form, also where they open a sentence.
    """
    buf, at = joined(texts)
    low = np.frombuffer(b"\n".join([_lower(t) for t in texts]) + b"\n", np.uint8)
    own, starts, ends = word_hashes(low, _PARTS, LOWER)
    n = len(own)
    if not n:
        empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        return [empty, empty]
    capital = (low != buf)[starts] | (low != buf)[np.minimum(starts + 1, ends - 1)] & (buf[starts] >= 0xC2)
    row = np.searchsorted(at, starts, side="right") - 1
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
    word = _in(own, _NUMBERS)
    number = (digits[ends] > digits[starts]) | word
    after, near = np.zeros(n, bool), np.zeros(n, bool)  # in the text of the token before; one character from it
    after[1:] = row[1:] == row[:-1]
    gap = starts[1:] - ends[:-1]
    near[1:] = after[1:] & (gap == 1)
    between = np.concatenate(([0], buf[ends[:-1]]))
    goes_on = np.zeros(n, bool)
    goes_on[1:] = number[1:] & number[:-1] & near[1:] & ((word[1:] & ((between[1:] == 32) | (between[1:] == 45))) | (_WITHIN[between[1:]] & _DIGIT[buf[starts[1:]]] & _DIGIT[buf[ends[:-1] - 1]]))
    unit = np.zeros(n, bool)
    unit[1:] = _in(own[1:], _UNITS) & number[:-1] & after[1:] & ~number[1:]
    token = own.copy()
    token[unit], token[number] = UNIT, NUMBER
    name = capital & ~number & ~unit
    barred = np.concatenate(([0], np.cumsum(~_BETWEEN[buf])))  # a run of names has only spaces and hyphens within, or the dot of an initial
    initial = (ends[:-1] - starts[:-1] == 1) & (buf[ends[:-1]] == 46)
    more = np.zeros(n, bool)
    more[1:] = name[1:] & name[:-1] & after[1:] & (gap <= 2) & (barred[starts[1:]] - barred[ends[:-1]] <= initial)
    return [_merged(row, np.where(name, NAME, token), own, goes_on | more), _merged(row, token, own, goes_on)]


def folded(token: np.ndarray, first: np.ndarray, n: int, form: int) -> np.ndarray:
    """Hashes of the n units from each place; those of different forms and lengths are apart."""
    h = token[first] + np.uint64(n << 3 | form)
    for j in range(1, n):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + token[first + j]
    return mix(h)


def _slots(token: np.ndarray) -> np.ndarray:
    return (token == NUMBER) | (token == NAME) | (token == UNIT)


def _windows(row: np.ndarray, token: np.ndarray, n: int, literals: int) -> np.ndarray:
    """Where windows of n units with enough literal ones start."""
    if len(row) < n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    if literals:
        literal = np.concatenate(([0], np.cumsum(~_slots(token))))
        first = first[literal[first + n] - literal[first] >= literals]
    return first


WINDOWS = "hash long, form int, size int, place int, slots binary"
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _described(token: np.ndarray, value: np.ndarray, begins: np.ndarray, first: np.ndarray, n: int, form: int, h: np.ndarray) -> list[tuple]:
    """Windows as (hash, form, size, place in their text, values of the slots; 0 for literal units)."""
    held = np.where(_slots(token), value, np.uint64(0)) if form != VERBATIM else np.zeros(len(token), np.uint64)
    return [(int(x), form, n, int(a - b), held[a : a + n].tobytes()) for x, a, b in zip(h.view(np.int64), first, begins, strict=True)]


def item_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, run: int = RUN) -> DataFrame:
    """(item_id, need, hash, form, size, place, slots) of every window of every item; ``need`` of them in a row make a passage.

    An item without a window of enough literal units stands for itself: all its windows must match with their values, or,
    if it has fewer units than a window, the whole of it, with changed values only where it has enough literal units.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, CHUNK_BYTES):
            out: list[tuple] = []
            for i, text in zip(ids.tolist(), texts, strict=True):
                forms = units([text])
                found: list[tuple[int, list[tuple]]] = []
                for form, (row, token, value) in enumerate(forms):
                    first = _windows(row, token, window, literals)
                    found.append((min(run, len(first)), _described(token, value, np.zeros(len(first), np.int64), first, window, form, folded(token, first, window, form))))
                if not any(rows for _, rows in found):
                    for form, (row, token, value) in enumerate((*forms, forms[PLAIN])):
                        n = min(len(row), window)
                        if not n or (form != VERBATIM and (n == window or np.count_nonzero(~_slots(token)) < literals)):
                            continue
                        first = _windows(row, token, n, 0)
                        found.append((len(first), _described(token, value, np.zeros(len(first), np.int64), first, n, form, folded(value if form == VERBATIM else token, first, n, form))))
                out += [(i, need, *r) for need, rows in found for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int32(), *_TYPES), strict=True)], names=["item_id", "need", "hash", "form", "size", "place", "slots"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").mapInArrow(trimmed(of), f"item_id long, need int, {WINDOWS}")


def window_filter(items: DataFrame) -> np.ndarray:
    """A bit for the first FILTER_BITS bits of every window hash; 64 rows of a sixty-fourth come to the driver."""
    part = FILTER_BITS - 6
    bits = F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("bit")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            bit = batch["bit"].to_numpy()
            for p in np.unique(bit >> part).tolist():
                if p != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["part", "map"])
                    at, held = p, np.zeros(1 << part, np.uint8)
                held[bit[bit >> part == p] & ((1 << part) - 1)] = 1
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["part", "map"])

    rows = items.select(bits).distinct().withColumn("part", F.shiftright("bit", part))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows.repartition(64, "part").sortWithinPartitions("part").select("bit").mapInArrow(pack, "part long, map binary").collect():
        out[r.part << (part - 3) : (r.part + 1) << (part - 3)] |= np.frombuffer(r.map, np.uint8)
    return out


def _candidates(docs: DataFrame, window: int, literals: int, kinds: set[tuple[int, int]], bits: np.ndarray) -> DataFrame:
    """(doc_id, text_md5, hash, form, size, place, slots) of the documents' windows that the map lets through."""
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())  # 8 MB, whatever the input

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = np.frombuffer(held.value, np.uint8)

        def found(ids: list, keys: list[str], texts: list[bytes]) -> pa.RecordBatch:
            out: list[tuple] = []
            forms = units(texts)
            for form, n in sorted(kinds):
                row, token, value = forms[min(form, PLAIN)]
                first = _windows(row, token, n, literals if form != VERBATIM else 0)
                h = folded(value if form == VERBATIM else token, first, n, form)
                bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((likely[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                first, h = first[hit], h[hit]
                of_row = row[first]
                out += [(ids[r], keys[r], *x) for r, x in zip(of_row.tolist(), _described(token, value, np.searchsorted(row, of_row), first, n, form, h), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.string(), *_TYPES), strict=True)], names=["doc_id", "text_md5", "hash", "form", "size", "place", "slots"])

        ids, keys, texts, size = [], [], [], 0
        for batch in slices(batches):
            for i, key, text in zip(batch["doc_id"].to_pylist(), batch["text_md5"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES // 2:
                    yield found(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
        if ids:
            yield found(ids, keys, texts)

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_md5().alias("text_md5"), "text")
    return rows.mapInArrow(trimmed(of), f"doc_id long, text_md5 string, {WINDOWS}")


def text_md5(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _stretches(joined_windows: DataFrame, window: int, parts: int) -> DataFrame:
    """(doc_id, text_md5, item_id, n_windows): the longest consistent stretch of windows in a row, if it reaches ``need``.

    A key's rows are the windows of one document that match one item, on one diagonal after another.
    """
    names = ["doc_id", "text_md5", "item_id", "form", "size", "diagonal", "place", "need", "slots", "theirs"]

    def longest(passage: list[tuple[int, bytes, bytes]]) -> int:
        """Windows are (place, slots of the document, slots of the item), by place."""
        base, size = passage[0][0], len(passage[0][1]) // 8
        length = passage[-1][0] - base + size
        mine, item = np.zeros(length, np.uint64), np.zeros(length, np.uint64)
        for place, a, b in passage:
            mine[place - base : place - base + size], item[place - base : place - base + size] = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        clash = np.full(length, -1, np.int64)  # the last place before that gives the same value another one
        seen: dict[int, tuple[int, int, int]] = {}
        for i in np.flatnonzero(item).tolist():
            value, other = int(item[i]), int(mine[i])
            was, last, before = seen.get(value, (other, -1, -1))
            if was != other:
                before = last
            clash[i] = before
            seen[value] = (other, i, before)
        start = np.array([p - base for p, _, _ in passage])
        least = np.searchsorted(start, np.maximum.accumulate(clash)[start + size - 1], side="right")
        return int((np.arange(len(start)) - least + 1).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, diagonal, passage, need = None, 0, None, [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal best, passage
            if passage and len(passage) >= need:
                n = longest(passage)
                if n >= need:
                    best = max(best, n)
            passage = []

        def end() -> None:
            nonlocal best
            close()
            if best:
                out.append((*key, best))
            best = 0

        for batch in slices(batches, 4096):
            for doc, md5, item, form, size, line, place, needs, slots, theirs in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if (doc, md5, item) != key:
                    end()
                    key, diagonal = (doc, md5, item), None
                if (form, size, line) != diagonal or place - passage[-1][0] > window:
                    close()
                    diagonal, need = (form, size, line), needs
                if not passage or passage[-1][0] != place:
                    passage.append((place, slots, theirs))
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        end()
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "text_md5", "item_id", "n_windows"])

    dealt = joined_windows.repartition(parts, "doc_id", "text_md5", "item_id").sortWithinPartitions("doc_id", "text_md5", "item_id", "form", "size", "diagonal", "place")
    return dealt.select(*names).mapInArrow(trimmed(run), "doc_id long, text_md5 string, item_id long, n_windows long")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, text_md5) of every document that holds a passage of a benchmark item, parameters changed or not.

    ``n_windows`` is the length of the longest consistent passage in windows; `item_windows` tells what a passage needs.
    Null and empty items and texts match nothing; rows that repeat an id and a text are one document; a document
    without an id is told by its text's MD5; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    items = materialise(item_windows(benchmark, window, literals, run), few_files(benchmark))
    kinds = {(r.form, r.size) for r in items.select("form", "size").distinct().collect()}  # two, or at most 3 x window
    bits = window_filter(items)
    with small_batches(spark):
        found = materialise(_candidates(docs, window, literals, kinds, bits).distinct(), few_files(docs))
    # A hash that many documents hold is a hot key: the items' windows are broadcast while few, and AQE splits it otherwise.
    theirs = items.select("item_id", "need", "hash", "form", "size", F.col("place").alias("there"), F.col("slots").alias("theirs"))
    met = found.join(F.broadcast(theirs) if small(theirs, BROADCAST_WINDOWS) else theirs, ["hash", "form", "size"]).withColumn("diagonal", F.col("place") - F.col("there"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _stretches(met, window, parts).select("doc_id", "item_id", "n_windows", "text_md5")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, run: int = RUN) -> DataFrame:
    """The rows whose text holds no passage of a benchmark item, with all their columns; null and empty texts stay.

    The verdict rests on the text alone, so rows without an id or with one that repeats are judged like all others.
    """
    key = free_name(docs, "text_md5")
    bad = materialise(contaminated(docs, benchmark, window, literals, run).select(F.col("text_md5").alias(key)).distinct(), few_files(docs))
    return by_id(docs.withColumn(key, text_md5()), bad, key, "left_anti").select(*docs.columns)


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5")
