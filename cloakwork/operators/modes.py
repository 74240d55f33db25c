"""Detection modes and aggregates over redacted documents, in Spark's own functions; the unified diff of one document on the driver."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def applied_rows(redacted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per replacement: id, pos, category, original, placeholder."""
    return redacted.select(id_col, F.posexplode("applied").alias("pos", "a")).select(id_col, "pos", "a.*")


def unique_applied(redacted: DataFrame) -> DataFrame:
    """The rows with each replacement once, in the order of the first."""
    return redacted.withColumn("applied", F.array_distinct("applied"))


def check(redacted: DataFrame) -> DataFrame:
    """(category, n) over all documents, by name; empty if nothing was found."""
    return redacted.select(F.explode("applied.category").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def check_fails(redacted: DataFrame) -> bool:
    """Whether a check must fail: anything was found. Reads until the first finding."""
    return not redacted.filter(F.size("applied") > 0).isEmpty()


def dry_run(redacted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, placeholder, original) once each, by placeholder."""
    return applied_rows(redacted, id_col).select(id_col, "placeholder", "original").distinct().orderBy(id_col, "placeholder", "original")


def changed_lines(redacted: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """(id, line, before, after) of the lines that differ. Lines are numbered from 1; null where one side has none."""
    lines = F.arrays_zip(F.split(text_col, "\n", -1).alias("before"), F.split(out_col, "\n", -1).alias("after"))
    rows = redacted.filter(~F.col(text_col).eqNullSafe(F.col(out_col))).select(id_col, F.posexplode(lines).alias("n", "l"))
    return rows.filter(~F.col("l.before").eqNullSafe(F.col("l.after"))).select(id_col, (F.col("n") + 1).cast("long").alias("line"), F.col("l.before").alias("before"), F.col("l.after").alias("after"))


def unified_diff(before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), "original", "redacted"))


def stats(redacted: DataFrame, *by: str, id_col: str | None = None) -> DataFrame:
    """(by, category, n_values, n_documents, n_replacements); a rollup over the columns in `by` if there are any. A document is a row, or all rows of an id."""
    told_by = F.monotonically_increasing_id() if id_col is None else F.struct(id_col)
    numbered = redacted.select(*by, "applied", told_by.alias("row"))  # before the rows multiply
    rows = numbered.select(*by, "row", F.explode("applied").alias("a")).select(*by, "row", F.col("a.category").alias("category"), F.col("a.original").alias("original"))
    grouped = rows.rollup(*by, "category") if by else rows.groupBy("category")
    return grouped.agg(F.countDistinct("row", "original").alias("n_values"), F.countDistinct("row").alias("n_documents"), F.count("*").alias("n_replacements"))


def unresolved_warning(restored: DataFrame, shown: int = 5) -> DataFrame:
    """(n, first, more) of each document with tokens that were not restored."""
    return restored.filter(F.size("unresolved") > 0).select("*", F.size("unresolved").alias("n"), F.slice("unresolved", 1, shown).alias("first"), F.greatest(F.size("unresolved") - shown, F.lit(0)).alias("more"))
