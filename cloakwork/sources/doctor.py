"""Checks of the surroundings: what works, what might not. Nothing is changed."""

from __future__ import annotations

import importlib.util
import os
import platform
import re
from pathlib import Path

from ..operators import rules as R
from . import config as settings
from .sessions import Store

PASS, WARN, FAIL, INFO = "PASS", "WARN", "FAIL", "INFO"


def checks(config_path: str | None = None, state_dir: str | Path | None = None, spark=None) -> list[tuple[str, str, str]]:
    """(status, what, detail) in order."""
    out = [(PASS if platform.python_version_tuple() >= ("3", "11") else FAIL, "python", platform.python_version())]
    out += [(PASS if importlib.util.find_spec(m) else FAIL, m, "installed" if importlib.util.find_spec(m) else "missing") for m in ("pyspark", "pyarrow", "numpy", "pandas")]
    try:
        policy = settings.policy(settings.load(config_path) if config_path else {})
        out.append((PASS, "settings", f"{sum(r.enabled for r in policy.rules)} of {len(policy.rules)} rules on"))
    except settings.ConfigError as e:
        out.append((FAIL, "settings", str(e)))
    broken = [r.name for r in R.built_in() if re.compile(r.pattern).search("") is not None]
    out.append((FAIL, "rules", f"match empty text: {broken}") if broken else (PASS, "rules", "all compile"))
    if state_dir is not None:
        folder = Path(state_dir)
        if not folder.exists():
            out.append((INFO, "sessions", "no folder yet"))
        else:
            open_to_others = folder.stat().st_mode & 0o077
            out.append((WARN if open_to_others else PASS, "sessions", f"{len(Store(folder).names())} saved" + (", folder is open to others" if open_to_others else "")))
            out.append((PASS if os.access(folder, os.W_OK) else FAIL, "sessions folder", str(folder)))
    if spark is not None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        out.append((PASS, "shared folder", shared) if shared else (WARN, "shared folder", "spark.checkpoint.dir is not set; a local folder serves on one machine only"))
        out.append((INFO, "spark", spark.version))
    return out


def report(found: list[tuple[str, str, str]]) -> tuple[str, int]:
    """The lines to print, and the exit code: 1 if a check failed."""
    return "\n".join(f"{s:4} {w}: {d}" for s, w, d in found), int(any(s == FAIL for s, _, _ in found))
