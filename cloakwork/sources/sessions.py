"""Saved ledgers with a time to live, and the audit trail."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from pathlib import Path

from ..operators.ledger import Ledger
from .files import write_private

# fixed values
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
LONGEST = timedelta(days=3650)
DEFAULT = "last"


class SessionError(ValueError):
    pass


def lifetime(text: str) -> timedelta:
    m = re.fullmatch(r"([1-9][0-9]*)([smhdw])", text.strip(), re.I)
    if not m or (span := timedelta(seconds=int(m[1]) * UNITS[m[2].lower()])) > LONGEST:
        raise SessionError("a time to live is a whole number and s, m, h, d or w, 3650d at most")
    return span


def expired(session: dict | None, now: datetime | None = None) -> bool:
    """Maps without session data never expire; times must have a zone, and the end must follow the beginning."""
    if session is None:
        return False
    try:
        if set(session) - {"created_at", "expires_at"}:
            raise ValueError("unknown fields")
        created = datetime.fromisoformat(session["created_at"])
        end = datetime.fromisoformat(session["expires_at"]) if session.get("expires_at") else None
        if created.tzinfo is None or (end is not None and (end.tzinfo is None or end <= created)):
            raise ValueError("times without a zone, or out of order")
    except (KeyError, TypeError, ValueError) as e:
        raise SessionError(f"invalid session data: {e}") from e
    return end is not None and (now or datetime.now(timezone.utc)) >= end


class Store:
    """Sessions as private files in one folder."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def path(self, name: str | None = None) -> Path:
        name = DEFAULT if name is None else name.strip()
        if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or name in (".", ".."):
            raise SessionError(f"not a session name: {name!r}")
        self.folder.mkdir(parents=True, exist_ok=True)
        os.chmod(self.folder, 0o700)
        return self.folder / f"{name}.json"

    def save(self, ledger: Ledger, name: str | None = None, ttl: str | None = None, now: datetime | None = None) -> None:
        now = now or datetime.now(timezone.utc)
        session = {"created_at": now.isoformat()} | ({"expires_at": (now + lifetime(ttl)).isoformat()} if ttl else {})
        write_private(self.path(name), json.dumps(ledger.export(session), ensure_ascii=False))

    def open(self, name: str | None = None, now: datetime | None = None) -> Ledger:
        p = self.path(name)
        if not p.exists():
            raise SessionError(f"no session {p.stem!r}")
        try:
            data = json.loads(p.read_text(encoding="utf-8"))
        except (OSError, UnicodeError, json.JSONDecodeError) as e:
            raise SessionError(f"session {p.stem!r} is damaged: {e}") from e
        if not isinstance(data, dict):
            raise SessionError(f"session {p.stem!r} is damaged")
        if expired(data.get("session"), now):
            p.unlink()
            raise SessionError(f"session {p.stem!r} has expired")
        ledger = Ledger()
        ledger.load(data)
        return ledger

    def names(self, now: datetime | None = None) -> list[str]:
        """Sorted; expired ones go, damaged ones stay visible."""
        found = []
        for p in sorted(self.folder.glob("*.json")) if self.folder.is_dir() else []:
            try:
                gone = expired(json.loads(p.read_text(encoding="utf-8")).get("session"), now)
            except (OSError, ValueError, AttributeError):
                gone = False
            p.unlink() if gone else found.append(p.stem)
        return found

    def forget(self, name: str | None = None) -> None:
        self.path(name).unlink(missing_ok=True)


def audit_record(operation: str, applied: list[tuple[str, str, str]], sources: list[str], status: str = "emitted", full: bool = False, now: datetime | None = None) -> dict:
    unique = list(dict.fromkeys(applied))
    record = {"schema_version": 2, "ts": (now or datetime.now(timezone.utc)).isoformat(), "operation": operation, "status": status, "source_count": len(sources), "total": len(unique), "categories": dict(sorted(Counter(c for c, _, _ in unique).items()))}
    if full:
        record |= {"sources": sources, "substitutions": [dict(zip(("category", "original", "placeholder"), x, strict=True)) for x in unique]}
    return record


def audit(path: str | Path, record: dict, record_empty: bool = False) -> bool:
    """Appends a line to a private file. Never fails a run; says whether it wrote."""
    if not record["total"] and not record_empty:
        return False
    try:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
        with os.fdopen(handle, "a", encoding="utf-8") as f:
            f.write(json.dumps(record, ensure_ascii=False) + "\n")
        return True
    except OSError:
        return False
