"""Queries on corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import corpus
from skein.plans.registry import query, table

#: DuckDB's form of ``corpus.presegment``.
WORDS = r"words AS (SELECT doc_id, lang, source, unnest([x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> '']) AS word FROM documents)"
TF = WORDS + ", tf AS (SELECT doc_id, lang, word, count(*) AS tf FROM words GROUP BY ALL)"
IDF = TF + (
    ", n AS (SELECT lang, count(DISTINCT doc_id) AS n_docs FROM tf GROUP BY lang), df AS (SELECT lang, word, count(*) AS rdf FROM tf GROUP BY ALL)"
    ", idf AS (SELECT lang, word, rdf, ln(CAST(n_docs AS DOUBLE) / rdf) AS idf FROM df JOIN n USING (lang))"
)
SCORES = IDF + ", m AS (SELECT doc_id, max(tf) AS max_tf FROM tf GROUP BY doc_id), s AS (SELECT doc_id, lang, word, tf, tf * idf AS tfidf, (0.5e0 + 0.5e0 * tf / max_tf) * idf AS nfidf FROM tf JOIN idf USING (lang, word) JOIN m USING (doc_id))"


def words(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tokens(table(spark, sf, "documents"), keep=("doc_id", "lang", "source"))


@query(f"WITH {WORDS} SELECT lang, word, count(*) AS cwf FROM words GROUP BY ALL")
def corpus_word_freq(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.word_freq(words(spark, sf))


@query(f"WITH {TF} SELECT lang, word, count(*) AS rdf FROM tf GROUP BY ALL")
def raw_doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.doc_freq(corpus.term_counts(words(spark, sf)))


@query(f"WITH {TF} SELECT lang, count(DISTINCT doc_id) AS n_docs FROM tf GROUP BY lang")
def docs_per_lang(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.docs_per_group(corpus.term_counts(words(spark, sf)))


@query(f"WITH {IDF} SELECT lang, word, rdf, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.idf(corpus.term_counts(words(spark, sf))).withColumn("idf", F.round("idf", 6))


@query(f"WITH {SCORES} SELECT doc_id, lang, word, tf, round(tfidf, 6) AS tfidf FROM s")
def tfidf_scores(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tfidf(corpus.term_counts(words(spark, sf))).select("doc_id", "lang", "word", "tf", F.round("tfidf", 6).alias("tfidf"))


@query(f"WITH {SCORES} SELECT doc_id, lang, word, round(nfidf, 6) AS nfidf FROM s")
def nfidf_scores(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tfidf(corpus.term_counts(words(spark, sf))).select("doc_id", "lang", "word", F.round("nfidf", 6).alias("nfidf"))


@query(f"WITH {WORDS} SELECT word, source, lang, count(DISTINCT doc_id) AS df FROM words GROUP BY GROUPING SETS ((word), (source, word), (lang, word))")
def tfidf_three_level(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.multi_level_df(words(spark, sf))


STOP = ["the", "of", "and", "a", "to", "in", "de", "la", "le", "der", "die", "das", "el", "que"]


@query(f"WITH {WORDS} SELECT word, count(*) AS tf FROM words WHERE word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY word ORDER BY tf DESC, word LIMIT 500")
def vocab_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.vocabulary(words(spark, sf), spark.createDataFrame([(w,) for w in STOP], "word string"), 500)


@query(
    f"WITH {SCORES}, b AS (SELECT lang, word, max(nfidf) AS nfidf FROM s GROUP BY ALL), c AS (SELECT lang, word, count(*) AS cwf FROM words GROUP BY ALL)"
    " SELECT lang, word, round(nfidf, 6) AS nfidf, rdf, cwf, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(nfidf, 9) DESC, rdf DESC, cwf DESC, word) AS INTEGER) AS rank FROM b JOIN df USING (lang, word) JOIN c USING (lang, word)"
)
def word_rank(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.word_rank(words(spark, sf)).select("lang", "word", F.round("nfidf", 6).alias("nfidf"), "rdf", "cwf", "rank")


PROFILE = "p AS (SELECT sha256(text) AS hash, count(*) AS n, max(octet_length(encode(text))) AS length, min(doc_id) AS first FROM documents GROUP BY 1)"


@query(f"WITH {PROFILE} SELECT hash, n, CAST(length AS BIGINT) AS length, first FROM p")
def dup_profile(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.duplicate_profile(table(spark, sf, "documents")).drop("collision")


@query(
    f"WITH {PROFILE}, h AS (SELECT n, count(*) AS texts, CAST(sum(length) AS BIGINT) AS unique_bytes, CAST(sum(n * length) AS BIGINT) AS total_bytes FROM p GROUP BY n)"
    " SELECT *, CAST(sum(texts) OVER w AS BIGINT) AS cum_texts, CAST(sum(total_bytes) OVER w AS BIGINT) AS cum_bytes FROM h WINDOW w AS (ORDER BY n)"
)
def dup_histogram_running(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.multiplicity_histogram(corpus.duplicate_profile(table(spark, sf, "documents")))


@query("SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS texts FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY lang")
def bytes_by_lang_unique(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unique_bytes_by(table(spark, sf, "documents"))


@query("SELECT hash, min(doc_id) AS first, array_to_string(list_sort(list(DISTINCT source || '/' || lang)), ',') AS seen FROM (SELECT sha256(text) AS hash, * FROM documents) GROUP BY hash")
def obs_sets_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumns({"hash": F.sha2(F.col("text").cast("binary"), 256), "place": F.concat_ws("/", "source", "lang")})
    out = corpus.observation_sets(docs, "hash", "doc_id", ["place"])
    return out.select("hash", "first", F.array_join(F.transform("seen", lambda s: s["place"]), ",").alias("seen"))


@query("SELECT signatures, count(*) AS keys FROM (SELECT user_id, count(DISTINCT event_type || '|' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR)) AS signatures FROM events GROUP BY user_id) GROUP BY signatures")
def signature_diversity_hist(spark: SparkSession, sf: str) -> DataFrame:
    sig = F.concat_ws("|", "event_type", F.floor(F.col("value") / 50).cast("string"))
    return corpus.signature_histogram(table(spark, sf, "events"), "user_id", sig)


@query("WITH e AS (SELECT DISTINCT event_type, user_id FROM events) SELECT x.event_type AS a, y.event_type AS b, count(*) AS shared FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type <= y.event_type GROUP BY ALL")
def overlap_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.overlap_matrix(table(spark, sf, "events"), "event_type", "user_id")


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


_LEVELS = "l AS (SELECT doc_id, 'all' AS level, '' AS v, word FROM words UNION ALL SELECT doc_id, 'source', source, word FROM words UNION ALL SELECT doc_id, 'lang', lang, word FROM words)"


@query(
    f"WITH {WORDS}, {_LEVELS}, t AS (SELECT doc_id, level, v, word, count(*) AS tf FROM l GROUP BY ALL), d AS (SELECT level, v, count(DISTINCT doc_id) AS n FROM t GROUP BY ALL), f AS (SELECT level, v, word, count(*) AS df FROM t GROUP BY ALL)"
    " SELECT doc_id, level, word, tf, round(tf * ln(CAST(n AS DOUBLE) / df), 6) AS tfidf FROM t JOIN d ON t.level = d.level AND t.v IS NOT DISTINCT FROM d.v JOIN f ON f.level = t.level AND f.v IS NOT DISTINCT FROM t.v AND f.word = t.word".replace("doc_id, level, word, tf", "t.doc_id, t.level, t.word, tf")
)
def tfidf_by_level(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text").repartition("doc_id")
    return corpus.multi_level_tfidf(corpus.tokens(docs, keep=("doc_id", "lang", "source"))).select("doc_id", "level", "word", "tf", F.round("tfidf", 6).alias("tfidf"))
