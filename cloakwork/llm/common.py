"""Helpers that the operators of this subpackage share: shared storage, bounded memo, word splitting."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import shared_dir, small_batches, spread, stored

__all__ = ["WORD_TABLE", "Memo", "fresh_path", "released", "shared_dir", "small_batches", "spread", "stored", "table", "whole_groups", "words"]

#: ASCII bytes that end a word: everything below 0x80 but 0-9, A-Z and a-z. Bytes from 0x80 up belong to words.
WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else (b + 32 if 0x41 <= b <= 0x5A else 0x20)
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function of batches; when a task is through, its worker gives the memory that it no longer uses back to the system, as workers serve many stages."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return inner


class Memo(dict):
    """A memo of a pure function that is emptied when it holds `limit` entries, so that its memory is bounded."""

    def __init__(self, function, limit: int, longest: int = 64):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of bytes that are digits, a-z or outside ASCII. Null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows of whole groups; the rows come sorted by the first `keys` columns. Holds a group and a batch at most."""
    held: list[pa.RecordBatch] = []

    def last_key(b: pa.RecordBatch):
        return tuple(b.column(c)[-1].as_py() for c in range(keys))

    for b in batches:
        if not b.num_rows:
            continue
        end = last_key(b)
        changed = np.zeros(b.num_rows, bool)
        for c in range(keys):
            changed |= np.asarray(b.column(c)) != end[c]
        cut = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        if held and (cut or last_key(held[-1]) != end):
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
