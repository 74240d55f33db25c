"""Restoring originals, and what cannot be restored."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ledger import find_tokens

_BOUND = r"(?<![-.\w])(?:%s)(?!\w|[-.]\w)"


@lru_cache(64)
def _matcher(tokens: tuple[str, ...]) -> re.Pattern:
    return re.compile(_BOUND % "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))))


def restore_text(text: str, originals: dict[str, str]) -> tuple[str, list[tuple[str, str, str]]]:
    """Puts the originals back where a token stands whole and alone; says which were restored, once each."""
    used: dict[str, str] = {}

    def put(m: re.Match) -> str:
        used.setdefault(m[0], originals[m[0]])
        return originals[m[0]]

    if text in originals:
        return originals[text], [("restore", originals[text], text)]
    if originals:
        text = _matcher(tuple(originals)).sub(put, text)
    return text, [("restore", o, t) for t, o in used.items()]


@lru_cache(64)
def _anywhere(tokens: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True))))


_joins, _stands_before = re.compile(r"[-.\w]").match, re.compile(r"\w|[-.]\w").match


def embedded(text: str, originals: dict[str, str], before: str) -> dict[str, str]:
    """Runs of a redacted text in which a token touches a word, a dot or a hyphen, and what they were in the text before.

    Restoring leaves such tokens alone, as others may have made the run; with the whole run known it comes back too.
    """
    found: dict[str, str] = {}
    if not originals:
        return found
    tokens, place = _anywhere(tuple(originals)), 0
    while m := tokens.search(text, place):
        start, end = m.span()
        place = end
        if not (start and _joins(text[start - 1]) or _stands_before(text, end)):
            continue
        while start and _joins(text[start - 1]):
            start -= 1
        while end < len(text):
            if more := tokens.match(text, end):
                end = more.end()
            elif _joins(text[end]):
                end += 1
            else:
                break
        place, run = end, text[start:end]
        was = tokens.sub(lambda t: originals[t[0]], run)
        if was in before and run not in before:
            found.setdefault(run, was)
    return found


def unresolved(text: str) -> list[str]:
    """Token-shaped strings that are left, each once, in order."""
    return list(dict.fromkeys(m[0] for m in find_tokens(text)))


def restore_documents(docs: DataFrame, *, text_col: str = "redacted", map_col: str = "reverse_map", out_col: str = "restored") -> DataFrame:
    """The inverse of redact_documents: all columns, and out_col and unresolved. Null texts stay null."""
    kept = [c for c in docs.columns if c not in (out_col, "unresolved")]
    source = docs.select(*[docs[c] for c in kept], docs[text_col].alias("__text"), docs[map_col].alias("__map"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, left = [], []
            for t, m in zip(b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist(), strict=True):
                text = None if t is None else restore_text(t, dict(m or ()))[0]
                texts.append(text)
                left.append(unresolved(text or ""))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(left, pa.list_(pa.string()))], [*kept, out_col, "unresolved"])

    return source.mapInArrow(run, T.StructType([*source.select(*kept).schema.fields, T.StructField(out_col, T.StringType()), T.StructField("unresolved", T.ArrayType(T.StringType()))]))
