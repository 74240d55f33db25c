"""The outbound scan: credentials that survive in a text that is about to leave, found without any ledger."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grammar as g
from ..sources.storage import spread

_STRONG = [(c, re.compile(g.PATTERNS[p])) for c, p in g.OUTBOUND]
_CONTEXT = [(c, re.compile(p)) for c, p in g.OUTBOUND_CONTEXT]
_token, _domain = re.compile(g.OUTBOUND_TOKEN).fullmatch, re.compile(g.PUBLIC_DOMAIN)


def matches(text: str) -> Iterator[tuple[int, str, int, int]]:
    """(pattern's place in the order, category, start, end); several may cover one span."""
    for rank, (category, pattern) in enumerate(_STRONG):
        for m in pattern.finditer(text):
            yield rank, category, *m.span()
    for rank, (category, pattern) in enumerate(_CONTEXT, len(_STRONG)):
        for m in pattern.finditer(text):
            value = m["value"].rstrip("'\".,;:!?)")
            if value.casefold() not in g.SAFE_LITERALS and not _token(value):
                yield rank, category, *m.span("value")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(category, start, end) by start; of equal spans the first pattern's."""
    first: dict[tuple[int, int], str] = {}
    for _, category, start, end in matches(text):
        first.setdefault((start, end), category)
    return sorted(((c, *span) for span, c in first.items()), key=lambda f: f[1])


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per finding: id, category, start, end. The rule of equal spans is a window over (id, start, end)."""
    d = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = "array<struct<rank:int,category:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("rank", "category", "start", "end"), m, strict=True)) for m in matches(t or "")] for t in b.column(1).to_pylist()]
            arrow = pa.list_(pa.struct([("rank", pa.int32()), ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], ["id", "f"])

    rows = d.mapInArrow(run, T.StructType([d.schema["id"], T.StructField("f", T._parse_datatype_string(kind))])).select("id", F.explode("f").alias("f")).select("id", "f.*")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "start", "end").orderBy("rank"))).filter("r = 1")
    return best.select(F.col("id").alias(id_col), "category", "start", "end")


def warnings(text: str, originals: Iterable[str] = ()) -> dict[str, int]:
    """How many distinct public domains a text holds, and how many first labels of known host names stand bare in it."""
    domains = {d for m in _domain.finditer(text) if (d := m[0].casefold().rstrip(".")) not in g.SAFE_PUBLIC_DOMAINS and "example.internal" not in d}
    bare = set()
    for o in originals:
        label = o.partition(".")[0]
        if _domain.fullmatch(o) and len(label) > 1 and re.search(rf"(?<![.\w]){re.escape(label)}(?![.\w])", text, re.I):
            bare.add(label.casefold())
    return {k: len(v) for k, v in (("public_domain", domains), ("bare_hostname", bare)) if v}


def is_loopback(url: str) -> bool:
    try:
        host = urlsplit(url).hostname or ""
        return host.casefold() == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def is_remote(provider: str, host: str) -> bool:
    """Whether a prompt would leave this machine."""
    return provider != "ollama" or not is_loopback(host)


class Blocked(RuntimeError):
    pass


def build_prompt(question: str, document: str) -> str:
    return f"{question}\n\n---\n{document}\n---" if document.strip() else question


def ask_safely(question: str, document: str, policy, send: Callable[[str], str], *, remote: bool = True, force: bool = False, audit: Callable[[str, list], None] | None = None) -> str:
    """Redacts question and document in one scope, scans what would leave, writes the audit record, sends, restores the answer."""
    from .redact import redact_text
    from .restore import restore_text

    ledger = policy.ledger()
    document, log = redact_text(document, policy, ledger)
    question, more = redact_text(question, policy, ledger)
    prompt = build_prompt(question, document)
    found = scan(prompt) if remote else []
    if found and not force:
        raise Blocked("would send: " + ", ".join(sorted({c for c, _, _ in found})))
    if audit:
        audit("forced_attempt" if found else "attempted", log + more)
    return restore_text(send(prompt), ledger.originals())[0]
