"""Quality rules whose cutoffs are risk-controlled: native DataFrame expressions only.

Every rule rejects a document when a measure lies above a cutoff. Per stratum (language) and rule,
labelled good documents are a holdout: a cutoff is certified when the exact binomial test rejects
"it rejects more than ``risk`` of the good documents" at level ``delta`` divided by the number of all
hypotheses (strata x rules x cutoffs, Bonferroni). The lowest certified cutoff is used; without one
the rule is off in that stratum. The risk is shared between the rules, so that with probability
1 - delta no stratum loses more than ``risk`` of its good documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.session import durable

SPACE = " \t\n\x0b\x0c\r"
RISK, DELTA = 0.05, 0.05
#: Candidate cutoffs per measure, from strict to lenient.
CUTOFFS = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5),
    "shout_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "bar_share": (0.05, 0.1, 0.2, 0.3),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, windows: Column) -> Column:
    """Number of words inside 3-word windows that occur at least twice.

    Windows are compared by 64-bit hash; equal ones are neighbours after sorting (hash, place).
    """
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    covered = F.aggregate(
        _let(ranked, places), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with its base counts and the measures of the rules.

    Null or empty text: all counts 0, measures 0. Other columns of ``docs`` are kept out.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"),
        F.when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("words"))
    # split() twice in a lambda would run per element; a column of its own is computed once
    rows = rows.withColumn("windows", F.when(
        F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(
            F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))))
    lines = F.when(F.instr("text", "\n") > 0, F.filter(
        F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("lines", lines)
    counted = rows.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.col("lines").isNull(), 0).otherwise(
            F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("lines").isNull(), 1).otherwise(F.size("lines")).alias("n_lines"),
        _repeat_words(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^!A-Z]+", "")).cast("long").alias("n_shout"),
        F.length(F.regexp_replace("text", r"[^|]+", "")).cast("long").alias("n_bars"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbol_share"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_shout", "word_chars").alias("shout_share"),
        per("n_bars", "n_words").alias("bar_share"),
    )


def _false_rejection_p(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k): the exact p-value of "more than ``risk`` is rejected".

    Terms follow from each other; they are summed relative to the largest, in logarithms, so that large
    holdouts don't underflow. The table has a row per hypothesis, whose sum has k + 1 terms.
    """
    ratio = F.lit(risk / (1 - risk))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * ratio)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(
            F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    first = n * F.log(F.lit(1 - risk))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(n > 0, F.when(k >= n, F.lit(1.0)).otherwise(F.exp(total))).otherwise(F.lit(1.0))


def risk_controlled_cutoffs(measured: DataFrame, labels: DataFrame, cutoffs: dict | None = None,
                            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_rejected, p_value, certified of every hypothesis.

    A document counts as good if its labels (null ones left out) are all 1; several equal rows
    of labels count once, documents without a label are not used.
    """
    cutoffs = cutoffs or CUTOFFS
    good = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id"))
    pairs = [(rule, float(c)) for rule, cs in cutoffs.items() for c in cs]
    flags = [F.sum((F.col(rule) > c).cast("long")).alias(f"k{i}") for i, (rule, c) in enumerate(pairs)]
    counts = measured.join(good, "doc_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *flags)
    rows = counts.select("stratum", "n_good", F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("n_rejected"))
        for i, (rule, c) in enumerate(pairs)])).alias("h")).select("stratum", "n_good", "h.*")
    strata = counts.select(F.count(F.lit(1))).scalar()
    p = _false_rejection_p(F.col("n_good"), F.col("n_rejected"), risk / len(cutoffs))
    return rows.withColumn("p_value", p).withColumn("certified", F.col("p_value") <= delta / (strata * len(pairs)))


def apply_rules(measured: DataFrame, hypotheses: DataFrame, cutoffs: dict | None = None) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: no base rule and no certified cutoff rejects it."""
    rules = list(cutoffs or CUTOFFS)
    chosen = hypotheses.filter("certified").groupBy("stratum").agg(*[
        F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in rules])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = [F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in rules]
    verdict = over[0]
    for o in over[1:]:
        verdict = verdict | o
    return (measured.join(chosen, "stratum", "left").withColumn("base_failed", base)
            .withColumn("kept", ~(base | verdict)).drop(*[f"max_{r}" for r in rules]))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, measures and verdict of every document.

    Null text is empty text (base_failed); null lang is a stratum of its own; rows that repeat get
    the same row again; an empty table gives an empty result, empty labels certify nothing.
    """
    measured = durable(measure(docs.select("doc_id", "lang", "text")))
    return apply_rules(measured, risk_controlled_cutoffs(measured, labels.select("doc_id", "quality"),
                                                         risk=risk, delta=delta))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


QUERIES = {"op9_quality_rules": op9_quality_rules}

_GRID = ", ".join(f"('{r}', CAST({c} AS DOUBLE))" for r, cs in CUTOFFS.items() for c in cs)
_RULE_RISK = RISK / len(CUTOFFS)
ORACLES = {"op9_quality_rules": rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM docs, unnest(range(1, len(words) - 1)) AS r(i)),
twice AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c >= 2) GROUP BY doc_id),
counted AS (
  SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(list_aggregate(list_concat([''], words), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, instr(text, chr(10)) > 0 AS multi,
         length(regexp_replace(text, '[^!A-Z]+', '', 'g')) AS n_shout,
         length(regexp_replace(text, '[^|]+', '', 'g')) AS n_bars
  FROM docs LEFT JOIN covered USING (doc_id)),
measured AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
         n_dup_lines / CASE WHEN multi THEN greatest(n_lines, 1) ELSE 1 END AS dup_line_share,
         n_shout / greatest(word_chars, 1) AS shout_share, n_bars / greatest(n_words, 1) AS bar_share
  FROM counted),
long AS (UNPIVOT (SELECT doc_id, stratum, CAST(symbol_share AS DOUBLE) AS symbol_share,
    CAST(repeat_share AS DOUBLE) AS repeat_share, CAST(dup_line_share AS DOUBLE) AS dup_line_share,
    CAST(shout_share AS DOUBLE) AS shout_share, CAST(bar_share AS DOUBLE) AS bar_share FROM measured)
  ON symbol_share, repeat_share, dup_line_share, shout_share, bar_share INTO NAME rule VALUE v),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, cutoff) AS (VALUES {_GRID}),
tests AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k
  FROM long JOIN good USING (doc_id) JOIN grid USING (rule) GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1)
    - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RULE_RISK!r}) + (n - i) * ln(1 - {_RULE_RISK!r})))) END AS p FROM tests),
chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tails
  WHERE p <= {DELTA!r} / ((SELECT count(DISTINCT stratum) FROM tests) * (SELECT count(*) FROM grid)) GROUP BY ALL),
rejected AS (SELECT DISTINCT doc_id FROM long JOIN chosen USING (stratum, rule) WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rejected.doc_id IS NULL AS kept
FROM measured LEFT JOIN rejected USING (doc_id)"""}
