"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.sources.traces import TWEET, tweets


def firehose(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Tweets with URLs from JSON lines as files arrive."""
    return tweets(spark.readStream.schema(TWEET).option("maxFilesPerTrigger", files).json(folder))


def deduplicated(stream: DataFrame, key: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark: state is bounded by the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Feed batches to sink. With no interval all that is there is taken in and the query stops; the checkpoint resumes, so sinks are to be idempotent."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def append_new(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that appends the rows whose key it lacks, in a folder for each batch, which a batch that is tried again overwrites."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        try:
            old = spark.read.parquet(path).filter(F.col("batch") != number).select(*key)
            rows = rows.join(old, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def since_high_water(df: DataFrame, at: str, done: DataFrame | None) -> DataFrame:
    """Rows newer than the newest that was taken in."""
    if done is None:
        return df
    mark = done.agg(F.max(at).alias("__m"))
    return df.crossJoin(F.broadcast(mark)).filter(F.col("__m").isNull() | (F.col(at) > F.col("__m"))).drop("__m")


def replicate(source: DataFrame, keys: list[str], dest: str) -> int:
    """Append what dest lacks; the number of new rows."""
    spark = source.sparkSession
    try:
        old = spark.read.parquet(dest).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    new = source if old is None else source.join(old, keys, "left_anti")
    new = new.cache()
    try:
        n = new.count()
        if n:
            new.write.mode("append").parquet(dest)
        return n
    finally:
        new.unpersist()


def page_order(df: DataFrame, key: str, at: str) -> DataFrame:
    """Breadth first: the order of retrieval, one snapshot of each key a cycle, middles of each history first."""
    from pyspark.sql import Window

    per = Window.partitionBy(key)
    ranked = df.withColumn("__i", F.row_number().over(per.orderBy(at))).withColumn("__n", F.count("*").over(per))
    # numbers with many zero bits at the end are the middles of a binary search
    bits = F.bin("__i")
    zeros = F.length(bits) - F.length(F.rtrim(F.translate(bits, "0", " ")))
    return ranked.withColumn("cycle", F.floor(F.log2(F.col("__n").cast("double"))).cast("int") - zeros).drop("__i", "__n")


def window_counts(stream: DataFrame, at: str, by: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows (an extension: no source of these data needs it)."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size, slide or size), by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
