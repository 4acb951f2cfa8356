"""Quality rules with host verdicts (DataFrame functions only).

Each text is measured by base rules. Rule failures are then aggregated per
host (``source``), each host's failure rate is shrunk towards the corpus by a
beta prior whose two parameters are fitted to all hosts (method of moments),
and the host's verdict is joined back to its documents.

Defined cases: a null or empty text has no words and fails. Null hosts form
one host of their own. Repeated rows are measured and returned one by one.
With no documents the result is empty. Extra input columns are ignored.
A 3-word window is identified by a 64-bit hash inside its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import let, small_side, stored, table, words_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the fitted prior's weight, in documents.
MIN_PRIOR, MAX_PRIOR = 1.0, 1_000_000.0


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``words``."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                             | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def union_length(at: Column) -> Column:
            steps = F.transform(at, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - v, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(pairs, starts), union_length)

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                   .otherwise(covered(h)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(count(words))


def rule_columns(text: Column) -> dict[str, Column]:
    """The base measures of one text, as a struct column and its parts."""
    body = F.coalesce(text, F.lit(""))
    return {
        "by_words": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                           _repeat_words(w).alias("n_repeat_words"))),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                           lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def measure(docs: DataFrame, keep: dict[str, Column], text: str = "text", host: str = "source") -> DataFrame:
    """``keep`` columns, ``host`` and the base measures of every document."""
    rules = rule_columns(F.col(text))
    raw = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(host).alias("host"),
                      *[c.alias(k) for k, c in rules.items()])
    return raw.select(*keep, "host", "by_words.n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "by_words.n_repeat_words").withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, verdict.

    Counting is partial on each task first, so a host with a third of all rows
    reaches its reducer as one row per task. The prior is fitted to the hosts'
    rates weighted by documents: between-host variance is the observed variance
    less what binomial noise explains.
    """
    hosts = stored(measured.groupBy("host").agg(F.count("*").alias("host_docs"),
                                                F.sum(F.col("base_failed").cast("long")).alias("host_failed")),
                   "hosts")
    mean = F.sum("host_failed") / F.sum("host_docs")
    moments = hosts.select(
        mean.alias("m"),
        (F.sum(F.col("host_failed") * F.col("host_failed") / F.col("host_docs")) / F.sum("host_docs")
         - mean * mean - mean * (1 - mean) * F.count("*") / F.sum("host_docs")).alias("v")).first()
    m, v = float(moments["m"] or 0.0), float(moments["v"] or 0.0)
    weight = min(max(m * (1 - m) / v - 1, MIN_PRIOR), MAX_PRIOR) if v > 0 else MAX_PRIOR
    rate = (F.col("host_failed") + F.lit(m * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", F.round(rate, 6)).withColumn(
        "host_rejected", F.col("host_rate") > max_rate)


def judge(measured: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Join each host's verdict to its documents; ``measured`` is stored and
    holds no text unless the caller kept it."""
    hosts = host_verdicts(measured, max_rate).withColumnRenamed("host", "verdict_of")
    joined = measured.join(small_side(hosts), F.col("host").eqNullSafe(F.col("verdict_of")), "left")
    return joined.drop("verdict_of").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(stored(measure(docs, {"doc_id": F.col("doc_id")}), "rules")).drop("host")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass the base rules and whose host passes."""
    measured = stored(measure(docs, {"row": F.struct("*")}), "rules")
    return judge(measured).where("kept").select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
marked AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM marked, (VALUES (0), (1), (2)) AS x(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.host, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS host_docs, sum(base_failed::INT)::BIGINT AS host_failed FROM f GROUP BY host),
p AS (
  SELECT sum(host_failed) / sum(host_docs) AS a,
         sum(host_failed * host_failed / host_docs) / sum(host_docs) AS s, count(*) / sum(host_docs) AS q FROM h),
k AS (
  SELECT a, CASE WHEN s - a * a - a * (1 - a) * q > 0
    THEN least(greatest(a * (1 - a) / (s - a * a - a * (1 - a) * q) - 1, 1.0), 1000000.0)
    ELSE 1000000.0 END AS z FROM p),
r AS (SELECT host, host_docs, host_failed, round((host_failed + a * z) / (host_docs + z), 6) AS host_rate FROM h, k)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       host_docs, host_failed, host_rate, host_rate > 0.5 AS host_rejected,
       NOT base_failed AND NOT host_rate > 0.5 AS kept
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""
