"""What the command line refuses before it reads anything: flags that exclude or need each other, and outputs that would overwrite what is read."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

#: Flags of which a call takes one at most.
EXCLUSIVE = (
    ("init_config", "list_sessions", "forget_session", "forget_all", "doctor", "list_rules"),
    ("check", "dry_run", "diff", "scan", "restore"),
    ("output", "output_dir"),
)
#: Actions that take no files and none of the flags below them.
ALONE = {"init_config", "list_sessions", "forget_session", "forget_all", "doctor", "list_rules"}
WORK = ("files", "output", "output_dir", "check", "dry_run", "diff", "scan", "restore", "consume", "import_map", "export_map", "session", "save_session", "session_ttl", "audit_log")
#: Each flag with those that make no sense beside it.
REFUSED = {
    **dict.fromkeys(("check", "dry_run", "diff", "scan"), ("output", "output_dir", "export_map", "save_session")),
    "restore": ("profile", "targets", "export_map", "save_session", "enable", "disable", "redact", "allow"),
}
#: Each flag with those that it needs.
NEEDED = {"consume": ("restore", "session"), "session_ttl": ("save_session",), "output_dir": ("files",)}


def _shown(name: str) -> str:
    return "files" if name == "files" else "--" + name.replace("_", "-")


def problem(given: set[str]) -> str | None:
    """What is wrong with the names of the flags that a call sets; None if nothing is."""
    for group in EXCLUSIVE:
        if len(both := [_shown(f) for f in group if f in given]) > 1:
            return f"{' and '.join(both)} exclude each other"
    for flag in sorted(given & ALONE):
        if found := [_shown(f) for f in WORK if f in given]:
            return f"{_shown(flag)} stands alone, not with {', '.join(found)}"
    for flag, others in REFUSED.items():
        if flag in given and (found := [_shown(f) for f in others if f in given]):
            return f"{_shown(flag)} can't be used with {', '.join(found)}"
    for flag, others in NEEDED.items():
        if flag in given and (missing := [_shown(f) for f in others if f not in given]):
            return f"{_shown(flag)} needs {', '.join(missing)}"
    return None


def clash(read: list[Path], written: list[Path]) -> str | None:
    """A file that would be written twice, or be overwritten although it is read: by whatever path, links included."""
    places = Counter(p.resolve() for p in written)
    if twice := next((p for p, n in places.items() if n > 1), None):
        return f"{twice} would be written twice"
    for w in written:
        for r in read:
            if w.resolve() == r.resolve() or (w.exists() and r.exists() and w.samefile(r)):
                return f"{w} is read and would be overwritten"
    return None
