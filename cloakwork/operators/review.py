"""Filtering what a reviewing model reports, and chunking what it reads. The reviewer is an injected callable from a chunk to JSON findings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grammar import TEMPLATES

# --- fixed values ----------------------------------------------------------------------------------------------------

CHUNK_CHARS, OVERLAP_CHARS = 12_000, 256
CATEGORIES = frozenset({"credential", "target", "identity", "organization", "project", "other"})
SAFE_SOFTWARE = frozenset(
    "apache,apache httpd,nginx,iis,tomcat,lighttpd,httpd,caddy,gunicorn,uvicorn,openssh,dropbear,putty,ubuntu,debian,centos,fedora,kali,alpine,rhel,red hat,suse,arch linux,gentoo,slackware,linux,windows,"
    "windows server,macos,freebsd,openbsd,unix,solaris,microsoft,nlnet labs,nsd,isc,isc bind,bind,nmap,nmap project,mysql,postgresql,mariadb,mongodb,redis,mssql,sql server,oracle,sqlite,cassandra,elasticsearch,"
    "php,python,java,node.js,ruby,perl,go,.net,jenkins,grafana,gitlab,docker,kubernetes,ansible,terraform,prometheus,nagios,zabbix,wordpress,drupal,joomla,ssl,tls,http,https,ftp,smtp,dns,ldap,kerberos,smb,rdp,vnc,"
    "snmp,ntp,gobuster,metasploit,burp,nessus,openvas,nikto,sqlmap,hydra,john,hashcat,responder,bloodhound,mimikatz,crackmapexec,netexec,impacket,certipy,smbclient,rpcclient,enum4linux,linpeas,winpeas".split(",")
)
SAFE_WORDLISTS = frozenset(
    "rockyou.txt,rockyou.txt.gz,common.txt,big.txt,raft-large-words.txt,raft-medium-words.txt,raft-small-words.txt,raft-large-files.txt,raft-medium-files.txt,directory-list-2.3-medium.txt,directory-list-2.3-small.txt,"
    "directory-list-2.3-big.txt,directory-list-lowercase-2.3-medium.txt,best1050.txt,darkweb2017-top10000.txt,2023-200_most_used_passwords.txt,fasttrack.txt,probable-v2-top1575.txt,probable-v2-top12000.txt,"
    "xato-net-10-million-passwords.txt,names.txt,usernames.txt,top-usernames-shortlist.txt,subdomains-top1million-5000.txt,subdomains-top1million-20000.txt,subdomains-top1million-110000.txt,bitquark-subdomains-top100000.txt,"
    "fierce-hostlist.txt,namelist.txt".split(",")
)
SAFE_URLS = frozenset({"https://nmap.org", "https://nmap.org/submit/"})
TIMESTAMP = (
    r"(?:\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}(?::\d{2})?|\d{4}-\d{2}-\d{2}|\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}(?:\s+[A-Z]{2,5})?\s+\d{4}"
    r"|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\s+[A-Z]{2,5})?\s+\d{4})"
)
DURATION = r"(?i)\d+(?:\.\d+)?\s*(?:ms|msec|msecs|millisecond|milliseconds|s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours)"
#: What models add to a value: (pattern, replacement), in this order.
STRIPS = [
    (r"\s*\(.*\)\s*$", ""),
    (r"\s+[-–—].*$", ""),
    (r"^(\d+\.\d+\.\d+\.\d+):\d+$", r"\1"),
    (r"^[a-zA-Z][-a-zA-Z0-9+.]*://", ""),
    (r"^(\[[A-Z][A-Z0-9_]*\])(?::\d+)?(?:/.*)?$", r"\1"),
    (r"^(\d+\.\d+\.\d+\.\d+)[:/].*$", r"\1"),
]
KEYED = r"^[A-Za-z_][A-Za-z0-9_.-]{0,30}\s*[:=]\s*(.+)$"
EXTRA_TOKENS = [r"\[CUSTOM_[A-Z0-9_]*REDACTED_\d+\]", r"REDACTED_\d+", r"example(?:\d+)?\.internal\d*"]

_shape = re.compile("|".join([*(re.sub(r"\\\{n:\d+d\\\}", r"\\d+", re.escape(t)).replace(r"\{mask\}", r"\d{1,3}") for t in sorted(set(TEMPLATES.values()))), *EXTRA_TOKENS]))

Reviewer = Callable[[str], str]


def normalized(value: str) -> str:
    for pattern, put in STRIPS:
        value = re.sub(pattern, put, value)
    return value.strip().rstrip(".,;:!?")


def without_key(value: str) -> str:
    m = re.match(KEYED, value)
    return m[1].strip() if m else value


def is_token(value: str) -> bool:
    return _shape.fullmatch(value) is not None


def is_safe(value: str) -> bool:
    """Software, times, durations, public word lists: what ran, not whom it met."""
    v = value.strip().lower()
    first, *rest = v.split() or [""]
    named = v in SAFE_SOFTWARE or (rest and first in SAFE_SOFTWARE)
    return bool(named or re.fullmatch(TIMESTAMP, value.strip()) or re.fullmatch(DURATION, value.strip()) or v in SAFE_WORDLISTS or v in SAFE_URLS)


class Invented(ValueError):
    """A finding that the text does not hold."""


def filter_findings(values: list[str], source: str | None = None) -> list[str]:
    """The findings worth reporting, in the source's spelling, once each."""
    found: dict[str, str] = {}
    for raw in values:
        value = raw.strip().strip('"').strip("'").strip()
        core = normalized(value)
        if not value or any(is_token(c) for c in (value, core, normalized(without_key(value))) if c) or is_safe(core) or is_safe(value):
            continue
        if source is not None:
            places = [(source.casefold().find(c.casefold()), c) for c in (core, value) if c]
            hit = next(((p, c) for p, c in places if p >= 0), None)
            if hit is None:
                raise Invented(f"not in the text: {value!r}")
            value = source[hit[0] : hit[0] + len(hit[1])]
            core = normalized(value)
        found.setdefault(core.lower(), value)
    return list(found.values())


def parse(answer: str) -> list[tuple[str, str]]:
    """(value, category) of a reviewer's JSON; ValueError if it is anything but that."""
    data = json.loads(answer)
    if not isinstance(data, dict) or set(data) != {"findings"} or not isinstance(data["findings"], list):
        raise ValueError("an answer must hold a list of findings and nothing else")
    for f in data["findings"]:
        if not isinstance(f, dict) or set(f) != {"value", "category"} or f["category"] not in CATEGORIES or not isinstance(f["value"], str) or not f["value"].strip() or len(f["value"].splitlines()) != 1:
            raise ValueError(f"not a finding: {f!r}")
    return [(f["value"], f["category"]) for f in data["findings"]]


def chunks(text: str) -> Iterator[str]:
    """Pieces of at most CHUNK_CHARS that end after a line where they can, each beginning OVERLAP_CHARS before the last one's end."""
    start = 0
    while True:
        end = start + CHUNK_CHARS
        if end >= len(text):
            yield text[start:]
            return
        line = text.rfind("\n", start + 1, end)
        end = line + 1 if line > start else end
        yield text[start:end]
        start = max(end - OVERLAP_CHARS, start + 1)


def review(text: str, reviewer: Reviewer) -> list[str] | None:
    """Findings over all chunks; None if any answer is unusable, so that the caller fails closed."""
    try:
        return filter_findings([v for c in chunks(text) for v, _ in parse(reviewer(c))], text)
    except Exception:
        return None


def _mapped(docs: DataFrame, columns: list[str], out: str, kind: str, arrow: pa.DataType, function) -> DataFrame:
    kept = [c for c in docs.columns if c != out]
    source = docs.select(*kept, *[docs[c].alias(f"__{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(len(kept) + i).to_pylist() for i in range(len(columns))), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([function(*r) for r in rows], arrow)], [*kept, out])

    return source.mapInArrow(run, T.StructType([*source.select(*kept).schema.fields, T.StructField(out, T._parse_datatype_string(kind))]))


def chunk_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns and `chunks`, an array; the cuts are sequential, thus Arrow batches."""
    return _mapped(docs, [text_col], "chunks", "array<string>", pa.list_(pa.string()), lambda t: [] if t is None else list(chunks(t)))


def filter_reported(rows: DataFrame, *, values_col: str = "findings", text_col: str = "text") -> DataFrame:
    """All columns and `reported`: the filtered findings, null where one was invented (the review then counts as failed)."""

    def one(values, text):
        try:
            return filter_findings([v for v in values or [] if v is not None], text)
        except Invented:
            return None

    return _mapped(rows, [values_col, text_col], "reported", "array<string>", pa.list_(pa.string()), one)


def safe_findings(findings: DataFrame, value_col: str = "value") -> DataFrame:
    """The native part of the filter over a table of findings: tokens and known software leave through an anti join and a regex."""
    spark = findings.sparkSession
    software = spark.createDataFrame([(s,) for s in sorted(SAFE_SOFTWARE)], "name string")  # a fixed list
    v = F.lower(F.trim(F.col(value_col)))
    kept = findings.filter(~F.col(value_col).rlike(f"^(?:{_shape.pattern})$"))
    return kept.join(F.broadcast(software), (v == F.col("name")) | (F.substring_index(v, " ", 1) == F.col("name")) & F.contains(v, F.lit(" ")), "left_anti")
