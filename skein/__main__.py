"""Command line: ``python -m skein VERB --database FOLDER --schema NAME ...``. Tables are Parquet folders under FOLDER/NAME."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import history
from skein.plans import migration
from skein.session import get_spark
from skein.sources import capture, lists


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein", description=__doc__)
    top.add_argument("--master", help="Spark master; spark-submit sets it on a cluster")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.add_argument("--database", required=True)
        p.add_argument("--schema", default="ts")
        for a in args:
            p.add_argument(a)
        for flag, kw in options.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **kw)
        return p

    yes = {"action": "store_true"}
    verb("alexa", src={"required": True}, src_name={"default": "ranked sites"}, cache={}, top_n={"type": int, "default": 0}, http_only=yes, www_only=yes)
    verb("citizenlab", "source", repo={"required": True})
    verb("herdict", "source")
    verb("pinboard", "user", "file")
    verb("rescan", "to_rescan")
    verb("staticlist", "file")
    verb("newrun", copy_from={"required": True}, exclude={"default": ""}, quiet=yes)
    verb("import-batch", "folder")
    verb("extract")
    verb("tfidf")
    verb("change-intervals", "archive", "country", "output", vantage={"default": ""})
    verb("twitter", "folder", "checkpoint")
    return top


class Tables(dict):
    """Parquet folders by name."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark, self.root = spark, root

    def __missing__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def put(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.root}/{name}")


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or get_spark("skein", master=a.master)
    t = Tables(spark, f"{a.database}/{a.schema}")
    if a.verb == "alexa":
        t.put("urls_alexa", lists.ranked_sites(spark, a.src, a.top_n, a.http_only, a.www_only).withColumn("src", F.lit(a.src_name)))
    elif a.verb == "citizenlab":
        t.put("urls_citizenlab", lists.category_lists(spark, a.repo).withColumn("src", F.lit(a.source)))
    elif a.verb == "herdict":
        t.put("urls_herdict", lists.access_reports(spark, a.source))
    elif a.verb == "pinboard":
        t.put("urls_pinboard", lists.bookmarks(spark, a.file, a.user))
    elif a.verb == "rescan":
        t.put("urls_rescan", lists.rescan(spark, a.to_rescan))
    elif a.verb == "staticlist":
        t.put("urls_staticlist", lists.static_list(spark, a.file))
    elif a.verb == "newrun":
        old = Tables(spark, f"{a.database}/{a.copy_from}")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(old.root).select(F.regexp_extract("path", rf"{os.path.basename(a.copy_from)}/([^/]+)/", 1).alias("n")).distinct()
        for name, df in migration.copy_sources({r.n: old[r.n] for r in found.collect()}, [x for x in a.exclude.split(",") if x]).items():
            t.put(name, df)
            if not a.quiet:
                print(f"{name}: copied")
    elif a.verb == "import-batch":
        t.put("captures", capture.read_captures(spark, a.folder), "append")
    elif a.verb == "extract":
        from skein.functions.html import extract_pages
        from skein.functions.text import segmented

        pages = t["captures"].filter("error is null").select("url", F.decode("content", "UTF-8").alias("html"), F.sha2("content", 256).alias("hash")).groupBy("hash").agg(F.min("url").alias("url"), F.min("html").alias("html"))
        out = extract_pages(pages, keep=("hash",))
        t.put("extracted", out.withColumn("segmented", F.array(F.struct(F.lit("un").alias("l"), segmented(F.lit(None).cast("string"), F.col("text_pruned")).alias("t")))))
    elif a.verb == "tfidf":
        per_lang, per_text = migration.corpus_statistics(t["extracted"].select(F.col("hash").alias("id"), "segmented"))
        t.put("corpus_stats", per_lang)
        t.put("pruned_content_stats", per_text)
    elif a.verb == "change-intervals":
        from skein.operators.sinks import write_csv
        from skein.plans.views import history_stream

        write_csv(history.change_intervals(history_stream(t, a.archive, a.country, a.vantage), "url"), a.output)
    elif a.verb == "twitter":
        from skein.streaming.incremental import append_new, firehose, ingest

        ingest(firehose(spark, a.folder), append_new(f"{t.root}/urls_tweeted", ["id", "url"]), a.checkpoint).awaitTermination()


if __name__ == "__main__":
    run()
