"""Text preparation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .skew import heavy_keys, lookup_join

# The usual English stop words, and the words kept in spite of being one.
STOP_WORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him
his himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that
that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn
mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()
KEPT_WORDS = """not no very really too so but however excellent amazing terrible awful best worst love hate perfect
horrible fantastic disappointing""".split()
BIGRAM_TRIGGERS = ["very", "really", "extremely", "not"]
# Word blocks appended by sentiment, with the number of repeats.
SENTIMENT_BLOCKS = (
    ("excellent amazing fantastic incredible perfect wonderful outstanding superb", 3),
    ("great good nice enjoyable pleasant satisfying", 2),
    ("terrible awful horrible disappointing poor bad", 2),
)
# Valences of common opinion words; pass a full lexicon table for real use.
LEXICON = {
    "excellent": 2.7, "amazing": 2.8, "fantastic": 2.6, "incredible": 2.0, "perfect": 2.7, "wonderful": 2.7,
    "outstanding": 3.0, "superb": 3.1, "great": 3.1, "good": 1.9, "nice": 1.8, "enjoyable": 1.9, "pleasant": 2.3,
    "love": 3.2, "best": 3.2, "terrible": -2.1, "awful": -2.0, "horrible": -2.5, "disappointing": -2.2, "poor": -2.1,
    "bad": -2.5, "worst": -3.1, "hate": -2.7,
}


def merged(text: Column, summary: Column) -> Column:
    """Text followed by the summary three times; '' when both are empty."""
    t, s = F.coalesce(text, F.lit("")), F.coalesce(summary, F.lit(""))
    return F.when((t == "") & (s == ""), F.lit("")).otherwise(F.concat_ws(" ", t, s, s, s))


def cleaned(text: Column) -> Column:
    """Lower case, no links, only letters, digits, white space and . ! ? ' -"""
    no_links = F.regexp_replace(F.lower(text), r"http\S+", "")
    return F.regexp_replace(no_links, r"[^a-z0-9\s.!?'-]", " ")


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """White-space tokens without stop words, important words kept."""
    dropped = sorted(set(STOP_WORDS if stop is None else stop) - set(KEPT_WORDS))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(dropped))


def trigger_bigrams(words: Column) -> Column:
    """word_next for every trigger word that has a next word; ``words`` must be a plain column."""
    at = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    named = F.transform(at, lambda i: F.when(
        F.get(words, i - 1).isin(BIGRAM_TRIGGERS), F.concat_ws("_", F.get(words, i - 1), F.get(words, i))))
    return F.filter(named, lambda b: b.isNotNull())


def term_list(text: Column) -> Column:
    """Vectoriser tokens: runs of at least two word characters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w\w+"), F.lit(0))


def grams(words: Column, longest: int = 4, starts: Column | None = None) -> Column:
    """All 1- to longest-grams of a token list that start at its first ``starts`` positions.

    ``words`` must be a plain column: an expression here would be evaluated per position.
    """
    size = F.size(words)
    starts = size if starts is None else starts

    def of_length(n: int) -> Column:
        last = F.least(starts, size - F.lit(n - 1))
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return F.concat(*[of_length(n) for n in range(1, longest + 1)])


def sentiment(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, compound): valence sum s of the row's words, normalised s / sqrt(s^2 + 15).

    Only words found in ``lexicon`` (word, valence) leave the join, so the shuffle carries
    matches, not texts. Rows without a match are absent.
    """
    words = rows.select(key, F.explode(F.split(cleaned(F.col(text)), r"[^a-z0-9'-]+")).alias("word"))
    hits = words.join(lexicon, "word").groupBy(key).agg(F.sum("valence").alias("s"))
    return hits.select(key, (F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(15.0))).alias("compound"))


def sentiment_suffix(compound: Column, compat: bool = True) -> Column:
    """The word block of a compound value; compat repeats it without a separating space."""
    def block(i: int) -> Column:
        words, times = SENTIMENT_BLOCKS[i]
        return F.lit(" " + (words * times if compat else " ".join([words] * times)))

    return (F.when(compound >= 0.8, block(0)).when(compound >= 0.5, block(1))
            .when(compound <= -0.5, block(2)).otherwise(F.lit("")))


#: Bytes of a lemma table that is used in place; larger ones are joined.
LEMMA_BYTES = 8 << 20


def lemmatised(rows: DataFrame, key: str, words: str, lemmas: DataFrame, most: int = LEMMA_BYTES) -> DataFrame:
    """(key, words): tokens replaced by their lemma where the (form, lemma) table has one; order kept, a row for each row.

    A table of at most ``most`` bytes (measured) is dealt into buckets by the forms' hash and looked up token by token, without a
    shuffle. With a larger one the tokens are joined and meet again by the number of their row, so that the rows are the
    same either way. A form with several lemmas has the smallest one.
    """
    return _with_lemmas(rows.select(key, words), words, lemmas, most)


def _with_lemmas(rows: DataFrame, words: str, lemmas: DataFrame, most: int = LEMMA_BYTES) -> DataFrame:
    """``rows`` with the tokens of column ``words`` replaced, see lemmatised."""
    lemmas = lemmas.filter("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    size, n = lemmas.agg(F.sum(F.octet_length("form") + F.octet_length("lemma") + 32), F.count(F.lit(1))).first()
    if not n:
        return rows
    if size <= most:
        buckets = max(1, n // 4)
        filled = lemmas.groupBy(F.pmod(F.xxhash64("form"), F.lit(buckets)).alias("b")).agg(
            F.collect_list(F.struct("form", "lemma")).alias("e"))
        every = rows.sparkSession.range(buckets).withColumnRenamed("id", "b").join(filled, "b", "left")
        none = F.array().cast("array<struct<form:string,lemma:string>>")
        table = every.agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("e", none).alias("e")))).alias("t")).select(
            F.transform("t", lambda x: x["e"])).scalar()

        def lemma(word: Column) -> Column:
            bucket = F.get(F.col("_table"), F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"))
            return F.coalesce(F.get(F.filter(bucket, lambda e: e["form"] == word), F.lit(0))["lemma"], word)
        return rows.withColumn("_table", table).withColumn(words, F.transform(words, lemma)).drop("_table")
    # written, so that a row has the same number in both reads
    numbered = durable(rows.withColumn("_row", F.monotonically_increasing_id()))
    single = numbered.select("_row", F.posexplode(words).alias("pos", "form"))
    joined = lookup_join(single, lemmas, "form", "left", heavy_keys(single, "form"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "form").alias("w"))))
    found = joined.groupBy("_row").agg(F.transform(ordered, lambda p: p["w"]).alias("_found"))
    # rows without tokens keep their empty or null list
    return numbered.join(found, "_row", "left").withColumn(words, F.coalesce("_found", words)).drop("_row", "_found")


def prepare(rows: DataFrame, key: str, text: str = "text", summary: str = "summary", lexicon: DataFrame | None = None,
            lemmas: DataFrame | None = None, compat: bool = True, out: str = "text") -> DataFrame:
    """Whole preparation: merge, sentiment block, clean, tokens, lemmas, trigger bigrams."""
    if lexicon is None:
        lexicon = rows.sparkSession.createDataFrame(list(LEXICON.items()), "word string, valence double")
    base = rows.withColumn("_m", merged(F.col(text), F.col(summary)))
    mood = sentiment(base, key, "_m", lexicon)
    tagged = base.join(mood, key, "left").withColumn(
        "_w", tokens(cleaned(F.concat("_m", sentiment_suffix(F.coalesce("compound", F.lit(0.0)), compat)))))
    if lemmas is not None:
        tagged = _with_lemmas(tagged, "_w", lemmas)
    return tagged.withColumn(out, F.array_join(F.concat("_w", trigger_bigrams(F.col("_w"))), " ")).drop("_m", "_w", "compound")
