"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, embedding_dedup, language, line_dedup, main_text, mixing, repeats, simhash_docs, toxicity, vector_search

#: The tokenizer file, read on the driver only.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash", "source")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold(5) != 0))
    return toxicity.score(docs, model, "doc_id", (fold(5) == 0).alias("held_out"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs.filter(fold(3) != 1)), "doc_id", (fold(3) == 1).alias("held_out"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_docs.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": embedding_near_dedup,
    "op2_substring_dedup": substring_dedup,
    "op3_mixing": mixing_weights,
    "op4_nearest_neighbours": nearest_neighbours,
    "op5_line_dedup": fuzzy_line_dedup,
    "op6_main_text": html_main_text,
    "op7_toxicity": toxicity_scores,
    "op8_language_id": language_id,
    "op9_simhash_near_dedup": simhash_near_dedup,
    "op10_bpe": bpe_round_trip,
}

_RULE = "CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN FALSE ELSE list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_bool_or([coalesce(x <> 0, FALSE) FOR x IN embedding]) END"
_DOUBLES = "[CAST(x AS DOUBLE) FOR x IN embedding]"

#: SQL of the queries that SQL can express. Exact methods: what the approximate ones are held against.
SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, {_DOUBLES} AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_RULE}),
        p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, p.b FROM r JOIN p ON r.c = p.a),
        c AS (SELECT n, min(c) AS c FROM r GROUP BY n), k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT vec_id, coalesce(k.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.n = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op2_substring_dedup": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
        f AS (SELECT h, min(doc_id) AS lo FROM x GROUP BY h), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f USING (h) WHERE doc_id > lo),
        u AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS k FROM d), a AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY k) AS s FROM u ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op4_nearest_neighbours": f"""
        WITH v AS MATERIALIZED (SELECT vec_id, {_DOUBLES} AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_RULE}),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10""",
}


