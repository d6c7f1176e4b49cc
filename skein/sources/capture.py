"""Capture files and crawl archives: a magic line, six header lines, compressed page and log."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import decode_lenient

MAGIC = {b"\x7fcap 00\n": 0, b"\x7fcap 01\n": 1}
SCHEMA = "path string, country string, vantage string, access_time timestamp, url string, redir_url string, status string, detail string, elapsed double, content binary, log binary, version int, error string"


@dataclass
class Capture:
    url: str
    redir_url: str
    status: str
    detail: str
    elapsed: float
    content: bytes
    log: bytes
    version: int = 1


def read_capture(data: bytes) -> Capture:
    version = MAGIC.get(data[:8])
    if version is None:
        raise ValueError("not a capture file")
    *head, rest = data[8:].split(b"\n", 6)
    if len(head) < 6:
        raise ValueError("header is cut off")
    url, redir, status, detail = (h.decode("utf-8") for h in head[:4])
    n_content, n_log = map(int, head[5].split())
    if n_content + n_log != len(rest):
        raise ValueError("lengths do not add up to the file's")
    blob = lambda b: zlib.decompress(b) if b else b""
    return Capture(url, redir or url, status, detail, float(head[4]), blob(rest[:n_content]), blob(rest[n_content:]), version)


def write_capture(c: Capture) -> bytes:
    """The bytes of a file; version 0 writes nothing for an empty part, version 1 compresses it like any other."""
    blob = lambda b: b"" if c.version == 0 and not b else zlib.compress(b, 9)
    content, log = blob(c.content), blob(c.log)
    head = f"\x7fcap {c.version:02d}\n{c.url}\n{c.redir_url}\n{c.status}\n{c.detail}\n{c.elapsed:.6f}\n{len(content)} {len(log)}\n"
    return head.encode("utf-8") + content + log


def locale_of(path: str) -> tuple[str, str]:
    """(country, vantage) from the part of the file name after its first dot."""
    country, _, vantage = PurePosixPath(path).name.partition(".")[2].partition("_")
    return country, vantage


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All capture files under a path. A bad file gives a row with error, not a failed job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for name, at, data in zip(pdf["path"], pdf["modificationTime"], pdf["content"]):
                country, vantage = locale_of(name)
                try:
                    c = read_capture(bytes(data))
                    rows.append((name, country, vantage, at, c.url, c.redir_url, c.status, c.detail, c.elapsed, c.content, c.log, c.version, None))
                except (ValueError, zlib.error, UnicodeDecodeError) as e:
                    rows.append((name, country, vantage, at, *[None] * 8, str(e)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def write_captures(df: DataFrame, folder: str) -> None:
    """A file NN/NNN/NNN.locale for each row (serial, locale, url, redir_url, status, detail, elapsed, content, log), written where the rows are.

    folder has to be one that all executors share.
    """

    def put(rows) -> None:
        import os

        for r in rows:
            to = os.path.join(folder, shard_path(r.serial, r.locale))
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(f"{to}.part", "wb") as f:
                f.write(write_capture(Capture(r.url, r.redir_url, r.status, r.detail, r.elapsed, bytes(r.content), bytes(r.log))))
            os.replace(f"{to}.part", to)  # a task that is tried again leaves one whole file

    df.foreachPartition(put)


def shard_path(serial: int, locale: str) -> str:
    s = f"{serial:08d}"
    return f"{s[:-6]}/{s[-6:-3]}/{s[-3:]}.{locale}"


def dump(df: DataFrame) -> DataFrame:
    """Header lines as text."""
    return df.select("path", F.concat_ws("\n", "url", "redir_url", "status", "detail", F.format_string("%.6f", "elapsed"), F.decode("content", "UTF-8")).alias("text"))


def read_sqlite_pages(spark: SparkSession, path: str, table: str = "samples_html_content", jdbc: bool = False) -> DataFrame:
    """(url, date, html) of a crawl sample. With the driver's jar as a JDBC table; without it by a reader on the driver, for files of one machine."""
    if jdbc:
        raw = spark.read.format("jdbc").option("url", f"jdbc:sqlite:{path}").option("dbtable", table).load()
    else:
        import sqlite3

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            rows = [(u, str(d), h.encode() if isinstance(h, str) else h) for u, d, h in db.execute(f"SELECT url, date, html_content FROM {table}")]
        raw = spark.createDataFrame(rows, "url string, date string, html_content binary")
    return raw.select("url", F.col("date").try_cast("timestamp_ntz").alias("date"), decode_lenient(F.col("html_content").cast("binary")).alias("html"))
