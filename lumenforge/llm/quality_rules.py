"""Quality rules with robust multivariate outliers: minimum covariance determinant for each language and source.

Everything is SQL; nothing runs in Python. Word and line statistics come from array functions inside each row. The
transformed vectors are whole thousandths, so that all sums are exact whatever the order of rows, and the same SQL steps
run on Spark and, for the check, on DuckDB:

* starts: coordinate medians, with three scatters: scaled absolute deviations alone, and with them the correlations of
  spatial signs and of bounded transforms of the coordinates;
* concentration steps: the H share of rows of least Mahalanobis distance gives the next mean and covariance; a start's
  estimate is replaced while the determinant of its covariance falls, and of a group's starts the least determinant wins;
* covariances are made consistent for normal data, and floors are added to their diagonals (a regularised estimate: a
  statistic that is the same in nearly all rows must not reject the others); a row is rejected when its squared
  distance exceeds the chi-squared limit.

Rows that fail the base rules take no part in estimates. Groups of fewer than LEAST rows are pooled by language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.common import few_files, materialise, small, table

DIMS = 5
#: Share of rows that the estimate rests on, rows that a group needs, concentration steps at most (some 6 are taken).
H, LEAST, STEPS = 0.75, 60, 12
#: Of normal rows, the share that the limit rejects.
TAIL = 1e-6
#: Least standard deviations, in thousandths of the transformed units: length, word length, symbols, lines, repeats.
FLOORS = (450, 350, 250, 700, 620)


def chi_squared(x: float, df: int) -> float:
    """The distribution function of chi-squared with an odd number of degrees of freedom."""
    p = math.erf(math.sqrt(x / 2))
    for k in range(1, df, 2):
        p -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return p


def chi_squared_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, df) < p else (low, mid)
    return low


#: The factor that makes the covariance of the H share of least distances that of all, for normal rows, and the limit.
CONSISTENT = H / chi_squared(chi_squared_quantile(H, DIMS), DIMS + 2)
LIMIT = chi_squared_quantile(1 - TAIL, DIMS)
SPACES = " \t\n\x0b\f\r"


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), t.alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", "[\t-\r ]+"), lambda x: x != "")).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\t-\r ]")))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("g", windows)

    def repeated() -> Column:
        """Positions of windows that equal another one, in order."""
        placed = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        of = lambda s: F.filter(s, lambda e, i: (e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"]))
        found = F.element_at(F.transform(F.array(placed), of), 1)
        return F.array_sort(F.transform(found, lambda e: e["i"]))

    rows = rows.withColumn("p", F.when(F.size(F.array_distinct("g")) < F.size("g"), repeated()).otherwise(F.array().cast("array<int>")))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("p", start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    return rows.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


# ---- SQL that both engines run; {names} are relations ------------------------------------------------------------


def vectors_sql(base: str) -> str:
    share = lambda num, den, by: f"CAST(ROUND(1000 * LN(1 + {by} * CAST({num} AS DOUBLE) / GREATEST({den}, 1))) AS BIGINT)"
    return f"""SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      CAST(ROUND(1000 * LN(1 + CAST(n_words AS DOUBLE))) AS BIGINT) AS x1,
      CAST(ROUND(1000 * CAST(word_chars AS DOUBLE) / GREATEST(n_words, 1)) AS BIGINT) AS x2,
      {share("n_symbols", "word_chars", 100)} AS x3, {share("n_dup_lines", "n_words", 1000)} AS x4, {share("n_repeat_words", "n_words", 100)} AS x5
    FROM {base}"""


def sizes_sql(vectors: str) -> str:
    return f"SELECT lang, source, COUNT(*) AS n FROM {vectors} WHERE NOT base_failed GROUP BY lang, source"


def groups_sql(vectors: str, sizes: str) -> str:
    """Each row's group: its language and source, or its language alone where that has too few rows."""
    return f"""SELECT v.*, v.lang AS g1, CASE WHEN c.n >= {LEAST} THEN CONCAT('=', v.source) ELSE '' END AS g2
    FROM {vectors} v LEFT JOIN {sizes} c ON v.lang = c.lang AND v.source = c.source"""


I = range(1, DIMS + 1)  # noqa: E741
IJ = [(i, j) for i in I for j in range(1, i + 1)]
MEANS, FACTOR = [f"m{i}" for i in I], [f"l{i}{j}" for i, j in IJ]


def _each(text: str, over=I, sep: str = ", ") -> str:
    """The text for each index or pair of indices, as i and j."""
    return sep.join(text.format(**(dict(zip("ij", x, strict=True)) if isinstance(x, tuple) else {"i": x})) for x in over)


def _median(x: str, duck: bool) -> str:
    return f"QUANTILE_CONT({x}, CAST(0.5 AS DOUBLE))" if duck else f"PERCENTILE({x}, 0.5D)"


def medians_sql(rows: str, duck: bool) -> str:
    return f"SELECT g1, g2, {', '.join(f'{_median(f'x{i}', duck)} AS m{i}' for i in I)} FROM {rows} WHERE NOT base_failed GROUP BY g1, g2"


def scales_sql(rows: str, medians: str, duck: bool) -> str:
    """Medians, and absolute deviations scaled to standard ones, with the floors."""
    mads = ", ".join(f"{_median(f'CAST(ROUND(2 * ABS(r.x{i} - m.m{i})) AS BIGINT)', duck)} AS d{i}" for i in I)
    scales = ", ".join(f"SQRT(POWER(CAST(1.4826 AS DOUBLE) * d{i} / 2, 2) + {FLOORS[i - 1] ** 2}) AS d{i}" for i in I)
    return f"""SELECT g1, g2, {", ".join(MEANS)}, {scales} FROM (SELECT r.g1, r.g2, {_each("MAX(m.m{i}) AS m{i}")}, {mads}
      FROM {rows} r JOIN {medians} m ON r.g1 = m.g1 AND r.g2 = m.g2 WHERE NOT r.base_failed GROUP BY r.g1, r.g2) t"""


def _cholesky(sql: str, keep: str) -> str:
    """Adds the factor l of a covariance c, row by row."""
    for i, j in IJ:
        inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
        term = f"SQRT(GREATEST(c{i}{i}{inner}, CAST(1 AS DOUBLE)))" if i == j else f"(c{i}{j}{inner}) / l{j}{j}"
        sql = f"SELECT *, {term} AS l{i}{j} FROM ({sql}) f{i}{j}"
    return f"SELECT {keep}, {', '.join(MEANS)}, {', '.join(FACTOR)} FROM ({sql}) f"


def starts_sql(rows: str, scales: str) -> str:
    """Three estimates for each group: the scatter is diagonal, or has the correlations of spatial signs or of bounded values."""
    z = f"SELECT r.g1, r.g2, {_each('s.m{i}')}, {_each('s.d{i}')}, {_each('(r.x{i} - s.m{i}) / s.d{i} AS z{i}')} FROM {rows} r JOIN {scales} s ON r.g1 = s.g1 AND r.g2 = s.g2 WHERE NOT r.base_failed"
    z = f"SELECT *, GREATEST(SQRT({_each('z{i} * z{i}', sep=' + ')}), CAST(1e-9 AS DOUBLE)) AS z0 FROM ({z}) z"
    whole = "CAST(ROUND(1000 * {}) AS BIGINT) AS {}{}"
    z = f"SELECT *, {', '.join(whole.format(f'z{i} / z0', 'a', i) for i in I)}, {', '.join(whole.format(f'z{i} / SQRT(1 + z{i} * z{i})', 'b', i) for i in I)} FROM ({z}) y"
    sums = f"SELECT g1, g2, {_each('MAX(m{i}) AS m{i}')}, {_each('MAX(d{i}) AS d{i}')}, {_each('SUM(a{i} * a{j}) AS a{i}{j}', IJ)}, {_each('SUM(b{i} * b{j}) AS b{i}{j}', IJ)} FROM ({z}) x GROUP BY g1, g2"
    sums = f"SELECT s.*, st FROM ({sums}) s CROSS JOIN (SELECT 1 AS st UNION ALL SELECT 2 AS st UNION ALL SELECT 3 AS st) k"

    def c(i: int, j: int) -> str:
        if i == j:
            return f"d{i} * d{i} AS c{i}{i}"
        part = lambda x: f"d{i} * d{j} * {x}{i}{j} / SQRT(GREATEST(CAST({x}{i}{i} AS DOUBLE) * {x}{j}{j}, 1))"
        return f"CASE st WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN {part('a')} ELSE {part('b')} END AS c{i}{j}"

    return _cholesky(f"SELECT g1, g2, st, {', '.join(MEANS)}, {', '.join(c(i, j) for i, j in IJ)} FROM ({sums}) c", f"g1, g2, st, CAST({LEAST} AS BIGINT) AS n, CAST(1e300 AS DOUBLE) AS det, TRUE AS moved")


def distance_sql(rows: str, estimate: str, how: str = "JOIN") -> str:
    """Squared Mahalanobis distances by forward substitution in the Cholesky factor, one layer for each dimension."""
    sql = f"SELECT r.*, e.st, {', '.join(f'e.{c}' for c in (*MEANS, *FACTOR))}, e.n AS fitted FROM {rows} r {how} {estimate} e ON r.g1 = e.g1 AND r.g2 = e.g2"
    for i in I:
        before = "".join(f" - l{i}{j} * y{j}" for j in range(1, i))
        sql = f"SELECT *, (x{i} - m{i}{before}) / l{i}{i} AS y{i} FROM ({sql}) t{i}"
    return f"SELECT *, {_each('y{i} * y{i}', sep=' + ')} AS d2 FROM ({sql}) t"


def step_sql(rows: str, estimate: str) -> str:
    """The next estimate of each group and start: that of the H share of least distances (whole bins of distance) if its
    determinant is less, and otherwise the one before. One aggregation by bin; the rest works on its few rows."""
    x = f"(SELECT g1, g2, {_each('x{i}')} FROM {rows} WHERE NOT base_failed)"
    bins = f"SELECT *, CAST(FLOOR(64 * LN(1 + d2)) AS BIGINT) AS b FROM ({distance_sql(x, estimate)}) d"
    bins = f"SELECT g1, g2, st, b, COUNT(*) AS n, {_each('SUM(x{i}) AS s{i}')}, {_each('SUM(x{i} * x{j}) AS s{i}{j}', IJ)} FROM ({bins}) g GROUP BY g1, g2, st, b"
    bins = f"SELECT *, SUM(n) OVER (PARTITION BY g1, g2, st ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, SUM(n) OVER (PARTITION BY g1, g2, st) AS n_all FROM ({bins}) c"
    sql = f"SELECT g1, g2, st, CAST(SUM(n) AS BIGINT) AS n, {_each('SUM(s{i}) AS s{i}')}, {_each('SUM(s{i}{j}) AS s{i}{j}', IJ)} FROM ({bins}) u WHERE upto - n < {H} * n_all GROUP BY g1, g2, st"
    sql = f"SELECT g1, g2, st, n, {_each('s{i}{j}', IJ)}, {_each('CAST(s{i} AS DOUBLE) / n AS m{i}')} FROM ({sql}) a"
    sql = f"""SELECT g1, g2, st, n, {', '.join(MEANS)},
      {', '.join(f"(CAST(s{i}{j} AS DOUBLE) / n - m{i} * m{j}) * CAST({CONSISTENT!r} AS DOUBLE) {f'+ {FLOORS[i - 1] ** 2}' if i == j else ''} AS c{i}{j}" for i, j in IJ)} FROM ({sql}) m"""
    sql = f"SELECT *, 2 * ({_each('LN(l{i}{i})', sep=' + ')}) AS det FROM ({_cholesky(sql, 'g1, g2, st, n')}) h"
    best = ", ".join(f"CASE WHEN w.det < e.det - 1e-9 THEN w.{c} ELSE e.{c} END AS {c}" for c in ("n", *MEANS, *FACTOR, "det"))
    return f"SELECT e.g1, e.g2, e.st, {best}, w.det < e.det - 1e-9 AS moved FROM {estimate} e JOIN ({sql}) w ON e.g1 = w.g1 AND e.g2 = w.g2 AND e.st = w.st"


def least_sql(estimate: str) -> str:
    """Of each group's estimates that of the least determinant."""
    return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g1, g2 ORDER BY det, st) AS place FROM {estimate}) o WHERE place = 1"


def verdict_sql(rows: str, estimate: str) -> str:
    return f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND (fitted IS NULL OR fitted < {int(H * LEAST)} OR d2 <= {LIMIT}) AS kept FROM ({distance_sql(rows, estimate, "LEFT JOIN")}) v"""


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, the five statistics, base_failed, kept) of every row.

    A null text has no words and fails the base rules; null languages and sources are groups of their own; repeated rows
    count each; an empty table gives no rows; other columns are not read. Groups too small to estimate keep their rows.
    """
    spark = docs.sparkSession
    named: list[str] = []
    files = few_files(docs)

    def view(df: DataFrame) -> str:
        named.append(f"quality_{len(named)}_{id(docs)}")
        df.createOrReplaceTempView(named[-1])
        return named[-1]

    vectors = view(materialise(spark.sql(vectors_sql(view(base_statistics(docs))))))
    sizes = materialise(spark.sql(sizes_sql(vectors)), files)
    few = small(sizes, 20_000)  # groups; every relation below has as many rows, or three times as many

    def narrow(df: DataFrame) -> str:
        return view(F.broadcast(df) if few else df)

    rows = view(spark.sql(groups_sql(vectors, narrow(sizes))))
    medians = narrow(materialise(spark.sql(medians_sql(rows, False)), files))
    scales = narrow(materialise(spark.sql(scales_sql(rows, medians, False)), files))
    estimate = materialise(spark.sql(starts_sql(rows, scales)), files)
    for _ in range(STEPS):
        estimate = materialise(spark.sql(step_sql(rows, narrow(estimate))), files)
        if estimate.where("moved").isEmpty():
            break
    out = spark.sql(verdict_sql(rows, narrow(spark.sql(least_sql(narrow(estimate))))))
    for name in named:
        spark.catalog.dropTempView(name)
    return out


def op5_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op5_sql() -> str:
    """The same for DuckDB; windows are compared as strings there."""
    base = r"""SELECT d.doc_id, COALESCE(d.lang, '') AS lang, COALESCE(d.source, '') AS source,
      CAST(LEN(w) AS BIGINT) AS n_words, CAST(LENGTH(REGEXP_REPLACE(t, '[\t-\r ]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(LENGTH(t) - LENGTH(REGEXP_REPLACE(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(LEN(ls) - LEN(LIST_DISTINCT(ls)) AS BIGINT) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words
    FROM (SELECT *, COALESCE(text, '') AS t, LIST_FILTER(STRING_SPLIT_REGEX(COALESCE(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS w,
      LIST_FILTER(STRING_SPLIT(COALESCE(text, ''), chr(10)), lambda x: REGEXP_MATCHES(x, '[^\t-\r ]')) AS ls FROM documents) d
    LEFT JOIN (SELECT doc_id, COUNT(DISTINCT p) AS n FROM
      (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS p FROM
        (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS c FROM
          (SELECT doc_id, i, CONCAT(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g FROM
            (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 1)) AS i FROM
              (SELECT doc_id, LIST_FILTER(STRING_SPLIT_REGEX(COALESCE(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS w FROM documents) a) b) c) d
       WHERE c > 1) e GROUP BY doc_id) r ON d.doc_id = r.doc_id"""
    parts = [("q_base", base), ("q_vectors", vectors_sql("q_base")), ("q_sizes", sizes_sql("q_vectors")), ("q_rows", groups_sql("q_vectors", "q_sizes")), ("q_medians", medians_sql("q_rows", True)), ("q_scales", scales_sql("q_rows", "q_medians", True)), ("q_e0", starts_sql("q_rows", "q_scales"))]
    parts += [(f"q_e{k + 1}", step_sql("q_rows", f"q_e{k}")) for k in range(STEPS)] + [("q_least", least_sql(f"q_e{STEPS}"))]
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts) + "\n" + verdict_sql("q_rows", "q_least")
