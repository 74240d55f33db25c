"""Redaction of streams: stateless in document scope, with a shared dictionary in corpus scope."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.redact import Policy, redact_documents, redact_text

STATE, OUT = "map string", "session string, doc_id long, redacted string"


def redact_stream(docs: DataFrame, policy: Policy | None = None, *, text_col: str = "text") -> DataFrame:
    """Each document in a scope of its own: no state, so any sink and output mode will do."""
    return redact_documents(docs, policy, text_col=text_col)


def redact_sessions(docs: DataFrame, policy: Policy | None = None, *, session_col: str = "session", id_col: str = "doc_id", text_col: str = "text", ttl_ms: int = 86_400_000) -> DataFrame:
    """Documents of one session share a ledger, which is the state of its group and goes after ttl_ms without a document.
    Within a micro-batch documents are taken by id; over batches the order of arrival sets the numbers."""
    policy = policy or Policy()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ledger = policy.ledger()
        if state.exists:
            ledger.load(json.loads(state.get[0]))
        rows = pd.concat(list(frames)).sort_values("doc_id", kind="stable")
        texts = [None if t is None else redact_text(t, policy, ledger)[0] for t in rows["text"]]
        state.update((json.dumps(ledger.export()),))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session": key[0], "doc_id": rows["doc_id"], "redacted": texts})

    d = docs.select(F.col(session_col).cast("string").alias("session"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def category_counts(redacted: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Replacements by category in tumbling windows, with a watermark for late documents."""
    rows = redacted.withWatermark(time_col, late).select(time_col, F.explode("applied.category").alias("category"))
    return rows.groupBy(F.window(time_col, window), "category").count()
