"""What goes out: CSV, splits, reports; each distributed but for the few lines that a report prints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", False).option("lineSep", "\n").csv(path)


def write_split(df: DataFrame, accepted: Column, path: str, by: str = "lang") -> None:
    """Accepted and rejected rows of each group apart."""
    df.withColumn("accepted", F.coalesce(accepted, F.lit(False))).write.mode("overwrite").partitionBy(by, "accepted").option("header", True).csv(path)


def route(df: DataFrame, kind: Column, path: str) -> None:
    """Rows by class into a folder each."""
    df.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").option("header", True).csv(path)


def latex_matrix(cells: Iterable[tuple[str, str, int]], names: list[str]) -> str:
    """A symmetric matrix of counts as LaTeX rows, the upper triangle only."""
    at = {(a, b): n for a, b, n in cells}
    rows = [" & ".join([a, *[str(at.get((min(a, b), max(a, b)), 0)) if names.index(b) >= names.index(a) else "" for b in names]]) + r" \\" for a in names]
    return "\n".join([r"\begin{tabular}{l" + "r" * len(names) + "}", " & ".join(["", *names]) + r" \\", *rows, r"\end{tabular}"])


def report_by_hash(sets: DataFrame, hash_col: str) -> DataFrame:
    """n, report: an indented report of each content with its n observations; sorted by n it is the report of all."""
    seen = F.transform("seen", lambda s: F.concat(F.lit("  "), F.concat_ws(" ", *[s[c.name].cast("string") for c in sets.schema["seen"].dataType.elementType.fields])))
    return sets.select(F.size("seen").alias("n"), F.concat_ws("\n", F.col(hash_col).cast("string"), seen).alias("report"))


def site_blocks(urls: DataFrame) -> DataFrame:
    """Sorted URLs of each origin."""
    origin = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]+)", 1)
    return urls.select(origin.alias("origin"), "url").distinct().groupBy("origin").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def overview(df: DataFrame, names: dict[str, str], path: str) -> None:
    write_csv(df.select(*[F.col(c).alias(a) for c, a in names.items()]), path)
