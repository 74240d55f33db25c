"""Dictionaries as JSON maps (version 2) and as tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import Ledger, checked_map
from .files import write_private

MAP_DDL = "version int, mapping map<string,string>, reverse_mapping map<string,string>, counters map<string,bigint>, session struct<created_at:string,expires_at:string>"


def export_map(ledger: Ledger, path: str | Path, session: dict | None = None) -> None:
    write_private(Path(path), json.dumps(ledger.export(session), ensure_ascii=False, indent=2) + "\n")


def import_map(ledger: Ledger, path: str | Path) -> None:
    ledger.load(Path(path).read_text(encoding="utf-8"))


def map_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, placeholder, original) of map files, read by Spark; files of another shape are left out by `valid_maps`."""
    m = valid_maps(spark.read.text(path, wholetext=True).select(F.from_json("value", MAP_DDL).alias("m")).select("m.*"))
    return m.select("reverse_mapping", F.explode("mapping").alias("key", "placeholder")).select("key", "placeholder", F.col("reverse_mapping")[F.col("placeholder")].alias("original"))


def valid_maps(maps: DataFrame) -> DataFrame:
    """The maps that fulfil the format's rules, in Spark's functions."""
    keys_fit = F.forall(F.map_keys("reverse_mapping"), lambda k: F.array_contains(F.map_values("mapping"), k))
    return maps.filter(F.col("version").isin(1, 2) & F.col("mapping").isNotNull() & F.coalesce(keys_fit, F.lit(True)) & F.coalesce(F.forall(F.map_values("counters"), lambda n: n >= 0), F.lit(True)))


def save_dictionary(words: DataFrame, path: str, session: str, created: str, expires: str | None = None) -> None:
    """A corpus dictionary as a table, partitioned by session."""
    words.select("*", F.lit(session).alias("session"), F.lit(created).cast("timestamp").alias("created_at"), F.lit(expires).cast("timestamp").alias("expires_at")).write.partitionBy("session").mode("append").parquet(path)


def live_sessions(sessions: DataFrame, now: str | None = None) -> DataFrame:
    """The rows whose session hasn't expired."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return sessions.filter(F.col("expires_at").isNull() | (F.col("expires_at") > at))


__all__ = ["checked_map", "export_map", "import_map", "live_sessions", "map_table", "save_dictionary", "valid_maps"]
