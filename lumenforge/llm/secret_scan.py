"""Secret scan: fixed patterns, and long tokens that pass a battery of randomness tests under false-discovery control.

Everything is DataFrame functions; nothing runs in Python. A candidate is a long run of token characters. Its encoding
is inferred, and three tests ask whether its characters look drawn at random: a chi-squared test of the alphabet's
uniformity, a runs test about the alphabet's middle and the lag-1 serial correlation; Fisher's method combines them.
Decoys, which are natural for sure, go through the same battery: plain words of one case, and for each row all words
around its candidates, run together in each encoding and cut into pieces. For each encoding and class of lengths the share of decoys that
reach a p-value tells how many of the candidates that reach it would be false; each class has the least cut at which
that share of its finds is at most ``fdr``. Short tokens, on which the tests have no power, drop out by that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import materialise, table

# The base patterns. The words before an assignment count in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"  # runs are greedy: the least lengths drop just the short ones
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: What the combined p-value must reach, and the rate of false discoveries in a class.
ALPHA, FDR = 0.01, 0.05
#: The cuts that a class may have, and the lengths of decoys made from a row's words: the least of the first classes.
#: How many of a text's characters give them: all.
CUTS, MADE, WORDS_FROM = (ALPHA, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9), (20, 29, 40, 57, 80), None
#: Characters of words in each encoding, and how many of them are looked at first, then, and last. They change the time, never a level.
COMMON, STEPS = {"hex": "eadcbf", "base32": "EAINORSTLDCUMPGHBFVYKWQXZJ", "alnum": "eainorstldcumpghbfvykwqxzj", "base64": "-eainorstldcumpghbfvykwqxzj"}, (6, 14, 27)
SPAN = "array<struct<start:int,ord:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of the leftmost matches that do not overlap, in code points: what lies between them is what split() gives."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found).alias("g"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("ord"), end.alias("end")))
        return F.struct(end.alias("at"), (F.when(keep(x["g"]), F.concat(acc["out"], span)).otherwise(acc["out"]) if keep else F.concat(acc["out"], span)).alias("out"))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _normal_tail(z: Column) -> Column:
    """The upper tail of the normal distribution by its logistic approximation."""
    return _let(F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0)), lambda z: 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z)))


def encoding(token: Column) -> Column:
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _uniformity(plain: Column, chars: Column, n: Column, k: Column) -> Column:
    squares = _sum(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(plain, c, F.lit(""))), F.lit(2.0))))
    free = k - 1
    chi = F.greatest(k / n * squares - n, F.lit(0.0))
    return _normal_tail((F.pow(chi / free, F.lit(1.0 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))


def _runs(high: Column, n: Column) -> Column:
    """high: 1 for each character above the alphabet's middle, 0 for others."""

    def of(s: Column) -> Column:
        spread = lambda expected: F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        return _let(2 * s["high"] * (n - s["high"]) / n + 1, lambda expected: 2 * _normal_tail(F.abs((s["runs"] - expected) / spread(expected))))

    without = lambda part: F.octet_length(F.replace(high, F.lit(part), F.lit("")))
    turns = (2 * F.octet_length(high) - without("01") - without("10")) / 2  # neither overlaps itself
    return _let(F.struct((n - without("1")).alias("high"), (turns + 1).alias("runs")), of)


def _serial(values: Column, n: Column) -> Column:
    def of(d: Column) -> Column:
        lagged = _sum(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda a, b: a * b))
        squares = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
        return 2 * _normal_tail(F.abs(lagged / F.greatest(squares, F.lit(1e-9))) * F.sqrt(n))

    return _let(_sum(values) / n, lambda mean: _let(F.transform(values, lambda v: v - mean), of))


def battery(token: Column, kind: Column) -> Column:
    """The combined p-value of the three tests of a token of 20 or more characters under its encoding."""
    alphabets = F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv))
    setting = F.struct(F.when(kind == "hex", F.lower(token)).otherwise(F.translate(token, "-_", "+/")).alias("plain"), F.element_at(alphabets, kind).alias("alphabet"))

    def tests(s: Column) -> Column:
        n, k = s["n"], s["k"]
        places = F.transform(s["chars"], lambda c: F.call_function("locate", c, s["alphabet"]).cast("double"))
        high = F.call_function("translate", s["plain"], s["alphabet"], s["halves"])
        logs = lambda v: F.array(*(F.log(F.greatest(p, F.lit(1e-15))) for p in (_uniformity(s["plain"], s["chars"], n, k), _let(high, lambda h: _runs(h, n)), _serial(v, n))))
        return _let(places, lambda v: _let(-_sum(logs(v)), lambda half: F.exp(-half) * (1 + half + half * half / 2)))

    def ready(s: Column) -> Column:
        k = F.length(s["alphabet"])
        halves = F.concat(F.repeat(F.lit("0"), F.ceil(k / 2).cast("int")), F.repeat(F.lit("1"), F.floor(k / 2).cast("int")))
        more = F.struct(s["plain"].alias("plain"), s["alphabet"].alias("alphabet"), F.split(s["plain"], "").alias("chars"), F.length(s["plain"]).cast("double").alias("n"), k.cast("double").alias("k"), halves.alias("halves"))
        return _let(more, tests)

    return _let(setting, ready)


def _level(p: Column) -> Column:
    """How many of CUTS a p-value reaches."""
    return sum((p >= cut).cast("int") for cut in CUTS)


def _size(length: Column) -> Column:
    return F.least(F.floor(F.log2(length / F.lit(20.0)) * 2), F.lit(12)).cast("int")


def _natural_from(kind: str, n: int) -> float:
    """The sum of squared counts from which a token of n characters reaches no cut, whatever the other two tests say."""
    k = len(ALPHABETS[kind])
    half, step = 0.0, 8.0  # the largest at which Fisher's method reaches the first cut, and a little more
    while step > 1e-3:
        half, step = (half + step, step) if math.exp(-half - step) * (1 + half + step + (half + step) ** 2 / 2) >= CUTS[0] else (half, step / 2)
    spread = 2 / (9 * (k - 1))
    for squares in range(n, n * n + 1):
        z = min(((max(k / n * squares - n, 0.0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread), 8.0)
        if math.log1p(math.exp(1.5976 * z + 0.070566 * z**3)) > half + 0.01:
            return float(squares)
    return math.inf


def _piece_level(token: Column, kind: str) -> Column:
    """How many of CUTS a decoy reaches. The squared counts of some characters and the count of all others are at most the sum
    of all squared counts: most words reach no cut by that alone."""
    n = F.octet_length(token)  # of ASCII
    least = F.element_at(F.array(*(F.lit(_natural_from(kind, m)) for m in range(MADE[0], MADE[-1] + 1))), n - (MADE[0] - 1))
    steps = [x for x in (COMMON[kind][a:b] for a, b in zip((0, *STEPS), STEPS, strict=False)) if x]

    def tried(before: Column, half: Column, at: int) -> Column:
        if at == len(steps):
            return _let(battery(token, F.lit(kind)), _level)
        more = sum((F.pow(half - F.octet_length(F.replace(token, F.lit(c), F.lit(""))), F.lit(2.0)) for c in steps[at]), before - len(steps[at]) / 4)
        return _let(more, lambda now: F.when(now >= least, F.lit(0)).otherwise(tried(now, half, at + 1)))

    return _let(n - 0.5, lambda half: tried(half + 0.5, half, 0))  # c + (c - 0.5) squared - 0.25 is c squared


def _made(t: Column, found: Column) -> Column:
    """Decoys (encoding, size, how many, levels of those that reach a cut) from all words around the candidates of a text.

    They are run together in each encoding and cut into pieces of one length; what is left makes a shorter one, if it has the
    20 characters that a candidate must have.
    """
    around = F.when(F.size(found) > 0, F.regexp_replace(t, CANDIDATE, " ")).otherwise(t)
    length = F.element_at(F.array(*map(F.lit, MADE)), (F.pmod(F.xxhash64(t), F.lit(len(MADE))) + 1).cast("int"))

    def pieces(kind: str, value: Column, length: Column) -> Column:
        def of(each: Column) -> Column:
            group = lambda some, n: F.struct(F.lit(kind).alias("encoding"), _size(n).alias("size"), F.size(some).alias("n"), F.filter(F.transform(some, lambda p: p["level"]), lambda v: v > 0).alias("levels"))
            whole, rest = F.filter(each, lambda p: p["length"] == length), F.filter(each, lambda p: p["length"] < length)
            return F.concat(F.when(F.size(whole) > 0, F.array(group(whole, length))).otherwise(F.array()), F.transform(rest, lambda p: group(F.array(p), p["length"])))

        tokens = F.regexp_extract_all(value, F.concat(F.lit(f".{{{MADE[0]},"), length.cast("string"), F.lit("}")), F.lit(0))
        return _let(F.transform(tokens, lambda k: F.struct(F.octet_length(k).alias("length"), _piece_level(k, kind).alias("level"))), of)

    def of(x: Column) -> Column:
        forms = {"hex": F.regexp_replace(F.lower(x["plain"]), "[ghijklmnopqrstuvwxyz]+", ""), "base32": F.regexp_replace(F.upper(x["plain"]), "[0189]+", ""), "alnum": x["plain"], "base64": x["slug"]}
        return F.concat(*(pieces(k, v, x["length"]) for k, v in forms.items()))

    # Java looks listed characters up; it tests ranges much more slowly. \P{Alnum} is [^A-Za-z0-9]; what is left are letters and digits
    slug = F.struct(F.regexp_replace(around, r"\P{Alnum}+", "-").alias("slug"), length.alias("length"))
    return _let(slug, lambda x: _let(F.struct(x["slug"].alias("slug"), F.replace(x["slug"], F.lit("-"), F.lit("")).alias("plain"), x["length"].alias("length")), of))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base`` (spans of the base patterns), ``_tried`` (candidates with class, decoy and the cuts they reach) and
    ``_made`` (decoys of the row's words, counted)."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    low = docs.withColumn("_low", F.lower(t))
    any_word = F.lit(False)
    for w in WORDS:
        any_word = any_word | F.contains(F.col("_low"), F.lit(w))
    assign = F.when(any_word, _spans(t, ASSIGN, 0, lambda g: F.length(g) >= 12, 1)).otherwise(none)
    access = F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1)).otherwise(none)
    hexes = F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(none)
    found = F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, 3)).otherwise(none)

    def tried(s: Column) -> Column:
        def of(x: Column) -> Column:
            return F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["encoding"].alias("encoding"),
                            _size(F.length(x["token"])).alias("size"),
                            x["token"].rlike("^([A-Z]?[a-z]+|[A-Z]+)([-_/+]([A-Z]?[a-z]+|[A-Z]+))*$").alias("decoy"), _let(battery(x["token"], x["encoding"]), _level).alias("level"))

        token = F.substring(t, s["start"] + 1, s["end"] - s["start"])
        return _let(token, lambda k: _let(F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), k.alias("token"), encoding(k).alias("encoding")), of))

    return low.withColumn("_base", F.array_sort(F.concat(assign, access, hexes))).withColumn("_found", found).withColumn("_tried", F.transform("_found", tried)).withColumn("_made", _made(t, F.col("_found"))).drop("_low", "_found")


def classes(spans: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row: ``_open``, the classes (encoding, size) and for each the least level (number of CUTS) at which the expected
    share of false discoveries is at most ``fdr``; at most 4 x 13.

    Words are decoys of all encodings: they have none of their own. Longer natural tokens pass no more often than
    shorter ones, so a class may take the rate of a shorter one, which has more decoys. The natural tokens of a class
    are estimated from the candidates that don't reach the cut, and one more.
    """
    kinds = F.array(*map(F.lit, ALPHABETS))
    row = lambda decoy, encoding, c, n, levels: F.struct(F.lit(decoy).alias("decoy"), encoding.alias("encoding"), c["size"].alias("size"), n.alias("n"), levels.alias("levels"))
    one = lambda decoy, encoding, c: row(decoy, encoding, c, F.lit(1), F.array(c["level"]))
    words = F.flatten(F.transform(F.filter("_tried", lambda c: c["decoy"]), lambda c: F.transform(kinds, lambda k: one(True, k, c))))
    targets = F.transform(F.filter("_tried", lambda c: ~c["decoy"]), lambda c: one(False, c["encoding"], c))
    each = spans.select(F.explode(F.concat(words, targets, F.transform("_made", lambda c: row(True, c["encoding"], c, c["n"], c["levels"])))).alias("c")).select("c.*")
    reach = lambda k: F.sum(F.size(F.filter("levels", lambda v: v >= k + 1)))
    counts = each.groupBy("decoy", "encoding", "size").agg(F.sum("n").alias("n"), F.array(*map(reach, range(len(CUTS)))).alias("reach"))
    counts = materialise(counts)  # some hundred rows, which are used twice
    counts = counts.select("decoy", "encoding", "size", "n", F.posexplode("reach").alias("cut", "np"))
    held = counts.where("decoy").select(F.col("encoding").alias("_e"), F.col("size").alias("_s"), F.col("cut").alias("_c"), ((F.col("np") + 0.5) / (F.col("n") + 20.0)).alias("rate"))
    found = counts.where("not decoy and np > 0").join(F.broadcast(held), (F.col("encoding") == F.col("_e")) & (F.col("cut") == F.col("_c")) & (F.col("_s") <= F.col("size")), "left")
    rates = found.groupBy("encoding", "size", "cut").agg(F.first("n").alias("n"), F.first("np").alias("np"), F.coalesce(F.min("rate"), F.lit(0.5 / 20)).alias("rate"))
    ok = rates.where(F.col("rate") / (1 - F.col("rate")) * (F.col("n") - F.col("np") + 1) <= fdr * F.col("np"))
    least = ok.groupBy("encoding", "size").agg((F.min("cut") + 1).alias("level"))
    return least.agg(F.collect_list(F.struct("encoding", "size", "level")).alias("_open"))


def all_spans(spans: DataFrame, fdr: float = FDR) -> DataFrame:
    """Adds ``_spans``: the base spans and those candidates that reach the cut of their class, by start and kind."""
    one = F.broadcast(classes(spans, fdr))  # one row of at most 52 classes
    reaches = lambda c: F.exists("_open", lambda o: (o["encoding"] == c["encoding"]) & (o["size"] == c["size"]) & (o["level"] <= c["level"]))
    good = F.filter("_tried", lambda c: ~c["decoy"] & (c["level"] > 0) & reaches(c))
    extra = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end")))
    return spans.crossJoin(one).withColumn("_spans", F.array_sort(F.concat("_base", extra))).drop("_open")


def joined_spans(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    A null text counts as empty and has no spans; rows that repeat are scanned each, null ids stay; an empty table
    gives no rows; other columns are not read.
    """
    found = all_spans(materialise(with_spans(docs.select("doc_id", "text")).drop("text")), fdr)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["ord"] == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined_spans("_base").cast("binary"), 256).alias("base_sha256"), joined_spans("_spans").alias("spans"))


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", fdr: float = FDR, text: str = "text") -> DataFrame:
    """The same rows with every span of a secret replaced by ``mask``; overlapping spans make one. Null texts stay null."""
    found = all_spans(with_spans(docs, text), fdr)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["end"] <= acc["at"], acc).when(
            (s["start"] < acc["at"]) & (acc["at"] > 0), F.struct(s["end"].alias("at"), acc["out"].alias("out"))
        ).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return found.withColumn(text, F.when(F.size("_spans") > 0, clean).otherwise(t)).select(*docs.columns)


def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
