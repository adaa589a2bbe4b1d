"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import materialise, release, small_batches, table, trimmed

# Letters of other scripts that look like Latin ones, digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "l": "i"}
#: Terms that start with some weight, whatever the labels show.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
#: Phrases whose words don't count, whatever the labels show; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "stupid question", "class clown", "loser bracket", "pond scum")
SEED_WEIGHT = 3.0
#: Labelled rows that the lexicon is fitted on, at most; those of the smallest hashes.
SAMPLE_ROWS = 8_000
#: A stem's letters, and what the log-likelihood ratio of a term must reach.
STEM, EVIDENCE = range(3, 9), 22.0
#: A phrase is an exception if the texts that hold it would all be clean by chance less often than this.
CHANCE = 1e-4
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {c: chr(c - 0xFEE0).lower().translate({ord(k): v for k, v in DIGITS.items()}) for c in range(0xFF01, 0xFF5F)}
_ASCII = bytes(ord((DIGITS | {c: c.lower() for c in map(chr, range(65, 91))} | {"L": "i"}).get(chr(c), chr(c))) for c in range(128)) + bytes(range(128, 256))
_TOKEN = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case with look-alike letters, digits and signs as the letters they stand for (l counts as i)."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode()
    return text.lower().translate(_FOLD)


def _spaced(text: str) -> str:
    """The folded words of a text with one space around each."""
    return f" {_BREAK.sub(' ', fold(text)).strip()} "


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings, exception phrases, and the logistic fit of the two features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    fit: tuple[float, ...] = (-3.0, 1.0, 1.0)

    def automaton(self):
        """Patterns carry the space before a word, whole words and phrases also the one after; values say how far back they start."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for s, w in self.stems.items():
            a.add_word(f" {s}", (len(s) - 1, w, False))
        for s, w in self.words.items():
            a.add_word(f" {s} ", (len(s), w, False))
        for s in self.exceptions:
            f = f" {' '.join(_TOKEN.findall(fold(s)))} "
            a.add_word(f, (len(f) - 2, 0.0, True))
        a.make_automaton()
        return a

    def features(self, automaton, text: str) -> tuple[float, float]:
        """Weight a hundred words, and the whole weight; the heaviest pattern of a word counts, exceptions take it off."""
        spaced = _spaced(text)
        found: dict[int, float] = {}
        freed: list[tuple[int, int]] = []
        for end, (back, weight, exempt) in automaton.iter(spaced):
            if exempt:
                freed.append((end - back, end))
            else:
                found[end - back] = max(found.get(end - back, 0.0), weight)
        total = sum(w for s, w in found.items() if not any(a <= s < b for a, b in freed))
        return 100.0 * total / max(1, spaced.count(" ") - 1), total

    def probability(self, rate: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.fit
        return 1.0 / (1.0 + np.exp(-np.clip(a + b * np.log1p(rate) + c * np.log1p(total), -30, 30)))


def crc_mod(column: str, by: int) -> Column:
    """crc32 of an id's decimal text, modulo; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(by)), F.lit(0))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a small penalty."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return tuple(map(float, b))


def sample_labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of training documents: at most ``sample_rows`` labelled ids of the smallest hashes."""
    train = labels.where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = train.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).alias("toxic"))  # ids: a fixed number of rows


def _counts(rows: DataFrame, keys) -> DataFrame:
    """(key, clean, toxic, clean_docs, toxic_docs): how often texts of either kind hold a key, and how many do.

    ``keys`` makes a counter of each text; a task sends sums, so a text's words never travel one by one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keys()
        held: tuple[Counter, Counter] = Counter(), Counter()
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            cols = [pa.array(names, pa.string())] + [pa.array([c[k] for k in names], pa.int64()) for c in (*held, *seen)]
            for c in (*held, *seen):
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=["key", "clean", "toxic", "clean_docs", "toxic_docs"])

        for batch in batches:
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                mine = of(text)
                held[toxic].update(mine)
                seen[toxic].update(mine.keys())
                if len(held[0]) + len(held[1]) > 500_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(trimmed(count), "key string, clean long, toxic long, clean_docs long, toxic_docs long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "clean_docs", "toxic_docs")))


def _terms():
    """Words (with a space after) and word beginnings, and under '' the number of words."""

    def of(text: str) -> Counter:
        words = Counter(_TOKEN.findall(fold(text)))
        mine: Counter = Counter({"": words.total()})
        for w, n in words.items():
            mine[f"{w} "] += n
            for k in STEM:
                if k <= len(w):
                    mine[w[:k]] += n
        return mine

    return of


def _phrases(lexicon: Lexicon):
    """Words that a term of the lexicon stands in, and these with the word before or after."""

    def keys():
        automaton = Lexicon(lexicon.words, lexicon.stems, ()).automaton()

        def of(text: str) -> Counter:
            spaced, mine = _spaced(text), Counter()
            for at in {end - back for end, (back, _, _) in automaton.iter(spaced)}:
                end = spaced.index(" ", at)
                word, before, after = spaced[at:end], spaced[: at - 1].rpartition(" ")[2], spaced[end + 1 :].partition(" ")[0]
                mine[word] += 1
                if before:
                    mine[f"{before} {word}"] += 1
                if after:
                    mine[f"{word} {after}"] += 1
            return mine

        return of

    return keys


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seeds: tuple[str, ...] = SEED_TERMS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Weigh words and word beginnings by how much more often toxic texts hold them.

    Only labels of rows whose crc32(doc_id) mod 5 is not 0 are read. Counts are made in Spark on at most ``sample_rows``
    texts, which bound all that the driver gets: the terms with enough evidence, the phrases around them that clean texts
    alone hold, and two features of each text. No labels: the seed terms with their first weights.
    """
    with small_batches(docs.sparkSession):
        rows = materialise(sample_labelled(docs, labels, sample_rows).repartition(32))  # a bounded number of rows
        counts = materialise(_counts(rows, _terms))
    all_ = counts.where("key = ''").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("clean", "toxic"))).first()
    share = (all_.toxic + 1) / (all_.toxic + all_.clean + 2)
    n, a = F.col("toxic") + F.col("clean"), F.col("toxic")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    evidence = 2 * (part(a, share) + part(n - a, 1 - share))
    weight = F.log((a + 0.5) / (F.col("clean") + 0.5) * (1 - share) / share)
    top = counts.where("key != '' and toxic_docs >= 4").select("key", a.alias("n"), weight.alias("weight"), evidence.alias("evidence")).where((F.col("weight") > 1.5) & (F.col("evidence") > EVIDENCE))
    lexicon = Lexicon(words={fold(t): SEED_WEIGHT for t in seeds}, exceptions=exceptions)
    entries = top.collect()
    longest: dict[str, int] = {}  # of each beginning, the most frequent longer entry
    for r in entries:
        for k in range(1, len(r.key.strip())):
            longest[r.key[:k]] = max(longest.get(r.key[:k], 0), r.n)
    for r in entries:
        if r.key[-1] != " " and longest.get(r.key, 0) >= 0.9 * r.n:
            continue  # a longer entry says the same of nearly all its words
        (lexicon.words if r.key.endswith(" ") else lexicon.stems)[r.key.strip()] = float(r.weight)
    phrases = materialise(_counts(rows, _phrases(lexicon)))
    words = phrases.where("key not like '% %'").select(F.col("key").alias("word"), ((F.col("toxic_docs") + 0.5) / (F.col("toxic_docs") + F.col("clean_docs") + 1)).alias("share"))
    alone = phrases.where("key like '% %' and toxic_docs = 0 and clean_docs >= 4").withColumn("word", F.explode(F.split("key", " ")))
    free = alone.join(words, "word").groupBy("key").agg(F.max(F.col("clean_docs") * F.log(1 - F.col("share"))).alias("chance")).where(F.col("chance") < float(np.log(CHANCE)))
    lexicon.exceptions = (*exceptions, *sorted(r.key for r in free.collect()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            got = [lexicon.features(a, t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.float64()) for i in (0, 1)] + [batch["toxic"]], names=["rate", "total", "toxic"])

    x = rows.mapInArrow(trimmed(features), "rate double, total double, toxic boolean").toPandas().sort_values(["rate", "total", "toxic"])
    if x.toxic.nunique() > 1:
        lexicon.fit = fit_logistic(np.log1p(x[["rate", "total"]].to_numpy()), x.toxic.to_numpy(float))
    return lexicon


def toxicity_score(lexicon: Lexicon, text: str | Column = "text") -> Column:
    """The probability that a text is toxic, as a column; null counts as empty."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = lexicon.automaton()
        for part in parts:
            got = np.array([lexicon.features(a, t or "") for t in part], float).reshape(-1, 2)
            yield pd.Series(lexicon.probability(got[:, 0], got[:, 1]))
        release()

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have no hits and get the score of no hits. Repeated rows are scored each; a null doc_id
    counts as held out; other columns are not read. Empty labels: the seed lexicon; an empty table gives no rows.
    """
    lexicon = learn_lexicon(docs, labels, sample_rows)
    return docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), toxicity_score(lexicon).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

