"""Secret scans with corpus-wide ownership frequency: native DataFrame expressions only.

Three patterns and a wider one (long mixed tokens) give candidate spans. Candidate values are hashed
and counted by distinct owners (``source``) and repositories (``source``, ``lang``): a value that many
owners have is a copied example, one that a single owner has and that looks random is live-looking.
The wider candidates become spans only if they are live-looking; the three patterns always are spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.session import durable

#: kind, pattern, group whose length counts, least length; in the order of kinds at one place.
KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
               r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("mixed", "[A-Za-z0-9_+/-]+", 0, 20),
)
#: The same matches, but without those that are dropped for their length anyway: runs are maximal.
_SEARCH = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "mixed": "[A-Za-z0-9_+/-]{20,}"}
MAX_OWNERS, MAX_REPOSITORIES, MIN_DISTINCT_CHARS = 1, 2, 10


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of (gap before the match, match, value) of one kind; null where nothing is found."""
    search = F.lit(_SEARCH.get(kind, pattern))
    whole = F.regexp_extract_all(text, search, F.lit(0))
    value = F.regexp_extract_all(text, search, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, _SEARCH.get(kind, pattern), -1), F.length)
    found = F.transform(F.arrays_zip(whole.alias("m"), value.alias("v"), gaps.alias("g")), lambda x: F.struct(
        x["g"].alias("gap"), F.length(x["m"]).alias("len"), x["v"].alias("value")))
    return F.when(text.rlike(_SEARCH.get(kind, pattern)), F.filter(found, lambda x: x["len"].isNotNull()))


def find_spans(docs: DataFrame) -> DataFrame:
    """Candidate spans: doc_key, source, repository, kind, kind_no, start, end (code points), value.

    Matches of a kind are numbered in their text; a window over one document's matches of one kind
    turns gaps into places. Documents are told apart by id and text hash; repeated rows count once.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = F.array(*[F.struct(
        F.lit(i).alias("kind_no"), F.lit(k).alias("kind"), F.lit(least).alias("least"),
        _matches(F.col("_text"), k, p, g).alias("found")) for i, (k, p, g, least) in enumerate(KINDS)])
    rows = docs.select(_doc_key(docs).alias("doc_key"), "source", "lang", text.alias("_text")).select(
        "doc_key", "source", "lang", F.filter(kinds, lambda x: x["found"].isNotNull()).alias("kinds"))
    rows = rows.select("doc_key", "source", "lang", F.explode("kinds").alias("k")).select(
        "doc_key", "source", "lang", "k.kind_no", "k.kind", "k.least", F.posexplode("k.found").alias("nr", "f"))
    rows = rows.select("doc_key", "source", "lang", "kind_no", "kind", "least", "nr", "f.*").distinct()
    upto = Window.partitionBy("doc_key", "source", "lang", "kind_no").orderBy("nr").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return rows.withColumn("end", end).filter(F.length("value") >= F.col("least")).select(
        "doc_key", "source", F.struct("source", "lang").alias("repository"), "kind_no", "kind",
        (F.col("end") - F.col("len")).alias("start"), "end", "value")


def _doc_key(docs: DataFrame) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                       F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))


def ownership(spans: DataFrame) -> DataFrame:
    """Per candidate value (hash): distinct owners and repositories, each row counted map-side first."""
    return spans.groupBy("value_hash").agg(
        F.count_distinct("source").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """All spans: doc_key, kind, kind_no, start, end, value, n_owners, n_repositories, live.

    Null text is empty text, a null source is one owner, an empty table gives no rows. A document
    that stands twice in the table (same id and text) has its spans once.
    """
    value = F.col("value")
    mixed = (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")) | (F.col("kind") != "mixed")
    found = durable(find_spans(docs).filter(mixed).select(
        "doc_key", F.coalesce("source", F.lit("")).alias("source"),
        F.concat_ws("/", F.coalesce("repository.source", F.lit("")), F.coalesce("repository.lang", F.lit(""))).alias(
            "repository"),
        "kind", "kind_no", "start", "end", "value", F.sha2("value", 256).alias("value_hash")))
    looks = F.size(F.array_distinct(F.split("value", ""))) >= MIN_DISTINCT_CHARS
    spans = found.select("doc_key", "kind", "kind_no", "start", "end", "value", "value_hash").distinct().join(
        ownership(found), "value_hash").withColumn(
        "live", looks & (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    base = F.col("kind") != "mixed"
    # a wide candidate that meets a span of another kind in its document is that span seen again
    ends = Window.partitionBy("doc_key").orderBy("start", "kind_no", "end")
    before = F.max(F.when(base, F.col("end"))).over(ends.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(ends.rowsBetween(1, Window.unboundedFollowing))
    return (spans.withColumn("_before", before).withColumn("_after", after)
            .filter(base | (F.col("live") & (F.coalesce("_before", F.lit(0)) <= F.col("start"))
                            & (F.coalesce("_after", F.col("end")) >= F.col("end"))))
            .drop("_before", "_after", "value_hash"))


def scan_documents(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: counts and spans (see scan)."""
    item = F.struct("start", "kind_no", F.concat_ws(":", "kind", "start", "end").alias("s"))
    spans = scan(docs, **limits).groupBy("doc_key").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k, *_ in KINDS],
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.array_sort(F.collect_list(item)).alias("items"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), ",")
    spans = spans.select(
        "doc_key", *[f"n_{k}" for k, *_ in KINDS], "n_live", joined(F.col("items")).alias("spans"),
        joined(F.filter("items", lambda x: x["kind_no"] < 3)).alias("base"))
    keyed = docs.select("doc_id", _doc_key(docs).alias("doc_key"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in [f"n_{k}" for k, *_ in KINDS] + ["n_live"]]
    return keyed.join(spans, "doc_key", "left").select(
        "doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"))


def _fresh(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new in ``docs``."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def redact(docs: DataFrame, replacement: str = "[secret]", **limits) -> DataFrame:
    """``docs`` with every span replaced in its text; columns and rows stay.

    Overlapping spans are one. The value of an assignment goes with its name.
    """
    spans = scan(docs, **limits).groupBy("doc_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    key, places = _fresh(docs, "doc_key"), _fresh(docs, "spans")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(
                F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.lit(replacement)))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(
        F.col(places), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(
            F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return docs.withColumn(key, _doc_key(docs)).join(
        spans.select(F.col("doc_key").alias(key), F.col("spans").alias(places)), key, "left").withColumn(
        "text", F.when(F.col(places).isNotNull(), cut).otherwise(F.col("text"))).select(*docs.columns)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_secret_scan": op1_secret_scan}


def _duck_kind(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, lang, {no} AS kind_no, '{kind}' AS kind, {least} AS least, unnest(
    list_zip(regexp_extract_all(text, '{p}', 0), regexp_extract_all(text, '{p}', {group}),
             range(1, len(regexp_extract_all(text, '{p}', 0)) + 1),
             list_transform(string_split_regex(text, '{p}'), lambda x: length(x))[:-2])) AS f
  FROM docs WHERE regexp_matches(text, '{p}')"""


ORACLES = {"op1_secret_scan": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang
              FROM documents),
raw AS ({" UNION ALL ".join(_duck_kind(i, *k) for i, k in enumerate(KINDS))}),
placed AS (
  SELECT *, f[2] AS value, length(f[1]) AS len,
         sum(f[4] + length(f[1])) OVER (PARTITION BY doc_id, kind_no ORDER BY f[3]) AS stop FROM raw),
cand AS (
  SELECT doc_id, source, source || '/' || lang AS repository, kind_no, kind, CAST(stop - len AS BIGINT) AS start,
         CAST(stop AS BIGINT) AS stop, value FROM placed
  WHERE length(value) >= least AND (kind <> 'mixed' OR (regexp_matches(value, '[0-9]') AND
        regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
owners AS (SELECT value, count(DISTINCT source) AS o, count(DISTINCT repository) AS r FROM cand GROUP BY value),
rated AS (
  SELECT cand.*, len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT_CHARS} AND o <= {MAX_OWNERS}
         AND r <= {MAX_REPOSITORIES} AS live FROM cand JOIN owners USING (value)),
spans AS (
  SELECT * FROM rated a WHERE kind <> 'mixed' OR (live AND NOT EXISTS (
    SELECT 1 FROM rated b WHERE b.doc_id = a.doc_id AND b.kind <> 'mixed' AND b.start < a.stop AND b.stop > a.start))),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'mixed') AS n_mixed, count(*) FILTER (live) AS n_live,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind <> 'mixed') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_mixed, 0) AS n_mixed, coalesce(n_live, 0) AS n_live, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)"""}
