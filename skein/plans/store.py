"""A store of page texts, observations and statistics over named tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.relational import seed_missing, strict_update, upsert
from skein.operators.sampling import random_ids
from skein.plans import views

#: What get_page_texts can load besides id.
TEXT_COLUMNS = {"lang": "lang", "contents": "plaintext", "segmented": "segmented", "origin": "origin", "title": "title"}


class PageStore:
    """Tables are read by name; statistics are written back through ``write``. Nothing runs before an action but for single look-ups."""

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], None] | None = None, runs: Sequence[int] | None = None):
        self.spark, self.read, self.write, self.runs = spark, read, write, list(runs or [])
        self._pending: list[tuple[str, DataFrame]] = []

    def _tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.read(n) for n in names}

    @cached_property
    def locales(self) -> list[str]:
        return [r[0] for r in self.read("captured_pages").select("country").distinct().orderBy("country").collect()]

    def get_page_texts(self, where: str | None = None, limit: int | None = None, load: Sequence[str] = ("lang", "contents")) -> DataFrame:
        """id and the loaded columns. Statistics (``tfidf`` and so on) are joined only if they are asked for."""
        stats = [c for c in load if c.startswith("stat:")]
        if unknown := [c for c in load if c not in TEXT_COLUMNS and c not in stats]:
            raise ValueError(f"unknown columns {unknown}")
        df = views.page_text(self._tables("extracted_plaintext", "extracted_content_ov"))
        for c in stats:
            own = self.read("pruned_content_stats").filter(F.col("stat") == c[5:])
            own = own.filter(F.col("runs") == F.array(*map(F.lit, self.runs))) if self.runs else own
            df = df.join(own.select(F.col("text_id").alias("id"), F.col("data").alias(c[5:])), "id", "left")
        df = df.where(where) if where else df
        df = df.select("id", *[F.col(TEXT_COLUMNS.get(c, c[5:])).alias(c.removeprefix("stat:")) for c in load])
        return df.limit(limit) if limit is not None else df

    def get_random_page_texts(self, count: int, seed: int, where: str | None = None) -> DataFrame:
        return random_ids(self.get_page_texts(where), "id", count, seed)

    def get_page_observations(self, where: str | None = None, ordered: str | None = None, limit: int | None = None) -> DataFrame:
        orders = {"url": ["url"], "country": ["country", "url"], None: []}
        if ordered not in orders:
            raise ValueError(f"cannot order by {ordered}")
        df = views.page_observations(self._tables("captured_pages", "url_strings", "capture_coarse_result", "capture_fine_result", "capture_html_content", "extracted_content_ov", "extracted_plaintext"))
        df = df.where(where) if where else df
        df = df.orderBy(*orders[ordered]) if orders[ordered] else df
        return df.limit(limit) if limit is not None else df

    def get_random_page_observations(self, count: int, seed: int, where: str | None = None) -> DataFrame:
        key = F.xxhash64(F.lit(seed), "url", "country", "vantage", "access_time")
        return self.get_page_observations(where).orderBy(key, "url").limit(count)

    def get_observations_for_text(self, text_id: int) -> DataFrame:
        return self.get_page_observations(f"text_id = {int(text_id)}")

    def _part(self, table: str, row_id: int, column: str):
        row = self.read(table).filter(F.col("id") == row_id).select(column).first()
        return row[0] if row else None

    def get_contents(self, text_id: int) -> str | None:
        return self._part("extracted_plaintext", text_id, "plaintext")

    def get_raw_contents(self, content_id: int) -> bytes | None:
        return self._part("capture_html_content", content_id, "content")

    def get_segmented(self, text_id: int):
        return self._part("extracted_plaintext", text_id, "segmented")

    def get_headings(self, row_id: int):
        return self._part("extracted_headings", row_id, "headings")

    def get_links(self, row_id: int):
        return self._part("extracted_urls", row_id, "urls")

    get_resources = get_links

    def get_dom_stats(self, row_id: int):
        return self._part("extracted_dom_stats", row_id, "dom_stats")

    def get_corpus_statistic(self, stat: str, lang: str) -> tuple[int, dict[str, float]]:
        row = self.read("corpus_stats").filter((F.col("stat") == stat) & (F.col("lang") == lang) & (F.col("runs") == F.array(*map(F.lit, self.runs)).cast("array<int>"))).first()
        return (row["n_documents"], dict(row["data"] or {})) if row else (0, {})

    def get_text_statistic(self, stat: str, text_id: int) -> dict[str, float]:
        row = self.read("pruned_content_stats").filter((F.col("stat") == stat) & (F.col("text_id") == text_id) & (F.col("runs") == F.array(*map(F.lit, self.runs)).cast("array<int>"))).first()
        return dict(row["data"] or {}) if row else {}

    def update_corpus_statistics(self, rows: DataFrame) -> None:
        """rows (stat, lang, n_documents, data) replace those of the same runs."""
        new = rows.withColumn("runs", F.array(*map(F.lit, self.runs)).cast("array<int>"))
        self._pending.append(("corpus_stats", upsert(self.read("corpus_stats"), new, ["stat", "lang", "runs"])))

    def prepare_text_statistic(self, stat: str) -> DataFrame:
        """Rows of nulls for texts that lack the statistic."""
        ids = self.read("extracted_plaintext").select(F.lit(stat).alias("stat"), F.col("id").alias("text_id"), F.array(*map(F.lit, self.runs)).cast("array<int>").alias("runs"))
        out = seed_missing(self.read("pruned_content_stats"), ids, ["stat", "text_id", "runs"])
        self._pending.append(("pruned_content_stats", out))
        return out

    def update_text_statistic(self, rows: DataFrame, prepared: DataFrame | None = None) -> None:
        """rows (stat, text_id, data) fill prepared ones; a row that was not prepared is an error."""
        new = rows.withColumn("runs", F.array(*map(F.lit, self.runs)).cast("array<int>"))
        base = prepared if prepared is not None else self.read("pruned_content_stats")
        self._pending.append(("pruned_content_stats", strict_update(base, new, ["stat", "text_id", "runs"])))

    def __enter__(self) -> PageStore:
        self._pending.clear()
        return self

    def __exit__(self, kind, *_) -> None:
        """Write what was put on hold, unless the block failed."""
        last = dict(self._pending)
        self._pending.clear()
        if kind is None and last:
            if self.write is None:
                raise ValueError("the store is read-only")
            for name, df in last.items():
                self.write(name, df)
