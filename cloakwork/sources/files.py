"""Documents from files and back to files."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per file, read whole: doc_id (place in `paths` order), source, text. Any number of files; order by path within a pattern."""
    frames = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("arg"), F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")) for i, p in enumerate(paths)]
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f)
    return found.select(F.xxhash64("arg", "source").alias("doc_id"), "arg", "source", "text")


def joined_document(docs: DataFrame) -> DataFrame:
    """All files as one document, joined by line ends in the order of the arguments."""
    one = docs.agg(F.sort_array(F.collect_list(F.struct("arg", "source", "text"))).alias("x"))
    return one.select(F.lit(0).cast("long").alias("doc_id"), F.array_join(F.col("x.text"), "\n").alias("text"))


def table_documents(spark: SparkSession, path: str, text_col: str, id_col: str, fmt: str = "parquet", **options) -> DataFrame:
    """Documents from any table that Spark reads."""
    return spark.read.format(fmt).options(**options).load(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def write_redacted(redacted: DataFrame, path: str, fmt: str = "parquet", text_col: str = "redacted") -> None:
    """Nothing is visible before all documents were processed: Spark's committer publishes the folder at the end."""
    out = redacted.select(text_col).withColumnRenamed(text_col, "value") if fmt == "text" else redacted
    (out.write.text if fmt == "text" else out.write.format(fmt).save)(path)


def output_path(source: Path, common: Path, out_dir: Path) -> Path:
    """<out>/<path below the common parent>/<stem>.redacted<suffix>"""
    return out_dir / source.relative_to(common).parent / f"{source.stem}.redacted{source.suffix}"


def write_private(path: Path, text: str) -> None:
    """Atomically, readable by the owner only: for restored texts and maps."""
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        os.fchmod(handle, 0o600)
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
