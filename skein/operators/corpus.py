"""Corpus statistics: word and document frequencies, IDF, TF-IDF, vocabulary, duplicate-content profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.relational import row_numbers


def presegment(text: Column) -> Column:
    """Lower-case runs of letters and digits: the native stand-in for the full segmenter in ``functions.text``."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def tokens(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """One row for each word of each document."""
    return docs.select(*keep, F.explode(presegment(F.col(text))).alias("word"))


def term_counts(words: DataFrame, doc: str = "doc_id", group: str = "lang") -> DataFrame:
    """tf of each (document, group, word): the one large shuffle, which everything below reuses pre-aggregated."""
    return words.groupBy(doc, group, "word").agg(F.count("*").alias("tf"))


def word_freq(words: DataFrame, group: str = "lang") -> DataFrame:
    """Occurrences of each word in the whole corpus of a language."""
    return words.groupBy(group, "word").agg(F.count("*").alias("cwf"))


def doc_freq(tf: DataFrame, group: str = "lang") -> DataFrame:
    """Documents of a language that hold the word. tf has a row for each document and word, so rows are documents."""
    return tf.groupBy(group, "word").agg(F.count("*").alias("rdf"))


def docs_per_group(tf: DataFrame, doc: str = "doc_id", group: str = "lang") -> DataFrame:
    """Documents that have words in a language."""
    return tf.select(doc, group).distinct().groupBy(group).agg(F.count("*").alias("n_docs"))


def idf(tf: DataFrame, doc: str = "doc_id", group: str = "lang") -> DataFrame:
    """ln(documents of the language / documents with the word)."""
    n = docs_per_group(tf, doc, group)
    return doc_freq(tf, group).join(n, group).select(group, "word", "rdf", F.log(F.col("n_docs").cast("double") / F.col("rdf")).alias("idf"))


def tfidf(tf: DataFrame, doc: str = "doc_id", group: str = "lang") -> DataFrame:
    """tf * idf; tf and max_tf are over all languages of a document, idf is that of the word's language."""
    per_doc = Window.partitionBy(doc)
    own = tf.withColumn("tf_all", F.sum("tf").over(Window.partitionBy(doc, "word"))).withColumn("max_tf", F.max("tf_all").over(per_doc))
    out = own.join(idf(tf, doc, group), [group, "word"])
    norm = F.lit(0.5) + F.lit(0.5) * F.col("tf_all") / F.col("max_tf")
    return out.select(doc, group, "word", "tf", (F.col("tf_all") * F.col("idf")).alias("tfidf"), (norm * F.col("idf")).alias("nfidf"))


def multi_level_df(words: DataFrame, doc: str = "doc_id", levels: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Document frequency of a word overall and within each of the given columns, in one pass over grouping sets."""
    base = words.select(doc, "word", *levels).distinct()
    sets = [[F.col("word")], *[[F.col(c), F.col("word")] for c in levels]]
    return base.groupingSets(sets, "word", *levels).agg(F.count_distinct(doc).alias("df")).select("word", *levels, "df")


def multi_level_tfidf(words: DataFrame, doc: str = "doc_id", levels: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc, level, word, tf, tfidf: TF-IDF of each word of a document within the whole corpus (level ``all``) and within its value of each column.

    A document's word travels once for all levels, to its word's figures; levels become rows after that. Where words come dealt by document, counting them
    takes no shuffle of their rows.
    """
    tf = words.filter(F.col("word").isNotNull()).groupBy(doc, *levels, "word").agg(F.count("*").alias("tf"))
    own = tf.groupBy(doc, "word").agg(F.collect_list(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(levels)], "tf")).alias("l"))
    total = lambda rows: F.aggregate(F.transform(rows, lambda x: x["tf"]), F.lit(0).cast("long"), lambda p, q: p + q)
    level = lambda c, v, n: F.struct(F.lit(c).alias("level"), v.cast("string").alias("v"), n.alias("tf"))

    def within(i: int, c: str) -> Column:
        """A document's few values of a column, each with its count."""
        values = F.array_distinct(F.transform("l", lambda x: x[f"v{i}"]))
        return F.transform(values, lambda v: level(c, v, total(F.filter("l", lambda x: x[f"v{i}"].eqNullSafe(v)))))

    own = own.select(doc, "word", F.concat(F.array(level("all", F.lit(""), total(F.col("l")))), *[within(i, c) for i, c in enumerate(levels)]).alias("l"))
    docs = words.filter(F.col("word").isNotNull()).select(doc, *levels).distinct()
    docs = docs.select(doc, F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("v")), *[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("v")) for c in levels])).alias("l"))
    docs = docs.select(doc, "l.*").distinct().groupBy("level", "v").agg(F.count(doc).alias("n_docs"))  # a row for each value of a level
    df = own.select("word", F.explode("l").alias("l")).groupBy("l.level", "l.v", "word").agg(F.count("*").alias("df"))
    idf = df.join(docs, (df["level"] == docs["level"]) & df["v"].eqNullSafe(docs["v"])).select(df["level"], df["v"], "word", F.log(F.col("n_docs").cast("double") / F.col("df")).alias("idf"))
    idf = idf.groupBy("word").agg(F.collect_list(F.struct("level", "v", "idf")).alias("idfs"))
    out = own.join(idf, "word").select(doc, "word", F.explode("l").alias("l"), "idfs")
    of = F.get(F.filter("idfs", lambda x: (x["level"] == F.col("l.level")) & x["v"].eqNullSafe(F.col("l.v"))), F.lit(0))
    return out.select(doc, F.col("l.level").alias("level"), "word", F.col("l.tf").alias("tf"), (F.col("l.tf") * of["idf"]).alias("tfidf"))


def vocabulary(words: DataFrame, stop: DataFrame, size: int = 50_000) -> DataFrame:
    """The most frequent words that are not stop words; ties by word. The order and limit run as one top-k."""
    return words.join(stop, "word", "left_anti").groupBy("word").agg(F.count("*").alias("tf")).orderBy(F.desc("tf"), "word").limit(size)


def word_rank(words: DataFrame) -> DataFrame:
    """Words of each language by highest nfidf, then document and corpus frequency, then word.

    One count of words in documents gives all four figures. Ranks are numbers in the order of all words by language, less those before the language.
    """
    tf = term_counts(words)
    per_doc = Window.partitionBy("doc_id")
    own = tf.withColumn("tf_all", F.sum("tf").over(Window.partitionBy("doc_id", "word"))).withColumn("norm", F.lit(0.5) + F.lit(0.5) * F.col("tf_all") / F.max("tf_all").over(per_doc))
    n = docs_per_group(tf)  # a row for each language
    best = own.groupBy("lang", "word").agg(F.max("norm").alias("norm"), F.count("*").alias("rdf"), F.sum("tf").alias("cwf")).join(F.broadcast(n), "lang")
    best = best.select("lang", "word", (F.col("norm") * F.log(F.col("n_docs").cast("double") / F.col("rdf"))).alias("nfidf"), "rdf", "cwf")
    keyed = best.withColumns({"o1": -F.round("nfidf", 9), "o2": -F.col("rdf"), "o3": -F.col("cwf")})
    numbered = row_numbers(keyed, ["lang", "o1", "o2", "o3", "word"], "rank")
    sizes = tf.filter("lang is not null").select("lang", "word").distinct().groupBy("lang").agg(F.count("*").alias("c"))  # a row for each language
    before = sizes.select("lang", F.coalesce(F.sum("c").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), "lang").select("lang", "word", "nfidf", "rdf", "cwf", (F.col("rank") - F.col("before")).cast("int").alias("rank"))


def duplicate_profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct content by SHA-256: rows, length, first key, and whether two contents share the hash."""
    hashed = docs.select(key, F.col(text).alias("t"), F.sha2(F.col(text).cast("binary"), 256).alias("hash"))
    return hashed.groupBy("hash").agg(
        F.count("*").alias("n"), F.max(F.octet_length("t")).cast("long").alias("length"), F.min(key).alias("first"), (F.min("t") != F.max("t")).alias("collision")
    )


def multiplicity_histogram(profile: DataFrame) -> DataFrame:
    """Contents by how often they occur, with running sums; the window runs over one row for each multiplicity."""
    per = profile.groupBy("n").agg(F.count("*").alias("texts"), F.sum("length").alias("unique_bytes"), F.sum(F.col("n") * F.col("length")).alias("total_bytes"))
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumns({"cum_texts": F.sum("texts").over(run), "cum_bytes": F.sum("total_bytes").over(run)})


def unique_bytes_by(docs: DataFrame, group: str = "lang", text: str = "text") -> DataFrame:
    """Bytes of distinct texts of each group."""
    return docs.select(group, text).distinct().groupBy(group).agg(F.sum(F.octet_length(text)).cast("long").alias("bytes"), F.count("*").alias("texts"))


def observation_sets(obs: DataFrame, hash_col: str, key: str, members: list[str]) -> DataFrame:
    """For each content the sorted set of observations, and the key it was first seen under."""
    return obs.groupBy(hash_col).agg(F.array_sort(F.collect_set(F.struct(*members))).alias("seen"), F.min(key).alias("first"))


def signature_histogram(rows: DataFrame, by: str, signature: Column) -> DataFrame:
    """How many keys have how many distinct signatures."""
    per = rows.select(by, signature.alias("sig")).distinct().groupBy(by).agg(F.count("*").alias("signatures"))
    return per.groupBy("signatures").agg(F.count("*").alias("keys"))


def overlap_matrix(rows: DataFrame, source: str, key: str) -> DataFrame:
    """Keys that two sources share, for each pair of sources in order; the diagonal is a source's own distinct keys.

    Each key's sources are paired within the key's row, so no row meets another key's.
    """
    sets = rows.select(source, key).distinct().groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
