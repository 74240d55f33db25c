"""The command line: redact or restore files, with a map, a session, or a check only."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections import Counter
from pathlib import Path

from .operators.ledger import Ledger
from .operators.modes import unified_diff
from .operators.redact import Policy, redact_text
from .operators.restore import restore_text, unresolved
from .operators.safety import scan
from .sources import config as settings
from .sources import doctor, flags
from .sources.files import output_path, write_private
from .sources.maps import export_map, import_map
from .sources.sessions import SessionError, Store, audit, audit_record


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cloakwork", description="Replace sensitive values by stable typed placeholders, and restore them.")
    p.add_argument("files", nargs="*")
    p.add_argument("-o", "--output")
    p.add_argument("--output-dir")
    for flag in ("--check", "--dry-run", "--diff", "--restore", "--scan", "--list-rules", "--list-sessions", "--forget-all", "--init-config", "--doctor", "--consume", "-v"):
        p.add_argument(flag, action="store_true")
    for flag in ("--config", "--profile", "--targets", "--import-map", "--export-map", "--session", "--save-session", "--session-ttl", "--state-dir", "--audit-log", "--forget-session"):
        p.add_argument(flag)
    for flag in ("--enable", "--disable", "--redact", "--allow"):
        p.add_argument(flag, default="", help="comma-separated")
    return p


def _csv(text: str) -> list[str]:
    return [x for x in (y.strip() for y in text.split(",")) if x]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(a)
    except (ValueError, OSError, UnicodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _given(a: argparse.Namespace) -> set[str]:
    return {name for name, value in vars(a).items() if value}


def _paths(a: argparse.Namespace) -> tuple[list[Path], list[Path]]:
    """The files that a call reads, and those that it writes."""
    inputs = [Path(n) for n in a.files if n != "-"]
    read = inputs + [Path(p) for p in (a.config, a.targets, a.import_map) if p]
    return read, [Path(p) for p in (a.output, a.export_map, a.audit_log) if p] + (_outputs(inputs, a.output_dir) if a.output_dir else [])


def _loaded(a: argparse.Namespace) -> dict:
    """The settings. Restoring needs none of them, so a broken file doesn't stop it; the audit, which they may forbid, is left out then."""
    try:
        return settings.load(a.config) if a.config else {}
    except settings.ConfigError as e:
        if not a.restore:
            raise
        print(f"warning: {e}; restoring goes on without settings and without an audit record", file=sys.stderr)
        a.audit_log = None
        return {}


def _run(a: argparse.Namespace) -> int:
    if wrong := flags.problem(_given(a)) or flags.clash(*_paths(a)):
        raise ValueError(wrong)
    store = Store(a.state_dir or Path.home() / ".local/state/cloakwork/sessions")
    if a.init_config:
        settings.init(a.config or "cloakwork.toml")
        return 0
    if a.list_sessions:
        print("\n".join(store.names()))
        return 0
    if a.forget_session:
        store.forget(a.forget_session)
        return 0
    if a.forget_all:
        for name in store.names():
            store.forget(name)
        return 0
    if a.doctor:
        text, code = doctor.report(doctor.checks(a.config, store.folder))
        print(text)
        return code
    config = _loaded(a)
    policy = Policy() if a.restore else settings.policy(config, a.profile or os.environ.get("CLOAKWORK_PROFILE"), _csv(a.enable), _csv(a.disable))
    extra = [*settings.R.custom_values(_csv(a.redact))]
    if a.targets:
        extra += settings.read_targets(Path(a.targets).read_text(encoding="utf-8"))
    policy = policy.plus(*extra)
    if a.list_rules:
        for r in policy.rules:
            print(f"{r.name}\t{r.priority}\t{r.category}\t{'on' if r.enabled else 'off'}")
        return 0
    ledger = Ledger()
    if a.import_map:
        import_map(ledger, a.import_map)
    if a.session:
        ledger.load(store.open(a.session).export())
    for value in [*policy.allow, *_csv(a.allow)]:  # allowed values beat imported ones
        ledger.allow(value)
    names = a.files or ["-"]
    texts = [sys.stdin.read() if n == "-" else Path(n).read_text(encoding="utf-8") for n in names]
    if not a.output_dir:
        texts = ["\n".join(texts)]
    if a.scan:
        found = [f for t in texts for f in scan(t)]
        for c, s, e in found:
            print(f"{c}\t{s}\t{e}")
        return 1 if found else 0
    if a.restore:
        out = [restore_text(t, ledger.originals()) for t in texts]
        for t, _ in out:
            if left := unresolved(t):
                print(f"warning: {len(left)} tokens not restored: {', '.join(left[:5])}" + (f", +{len(left) - 5} more" if len(left) > 5 else ""), file=sys.stderr)
        code = _emit(a, names, [t for t, _ in out], private=True)
        if a.audit_log:
            audit(a.audit_log, audit_record("restore", [x for _, log in out for x in log], names))
        if a.consume and a.session:  # only once the output is there
            store.forget(a.session)
        return code
    done = [redact_text(t, policy, ledger) for t in texts]
    if len(done) > 1:  # what a later file taught holds for earlier ones too
        done = [(again, log + more) for (t, log) in done for again, more in [redact_text(t, policy, ledger)]]
    applied = [x for _, log in done for x in log]
    if a.check:
        for c, n in sorted(Counter(c for c, _, _ in applied).items()):
            print(f"{c}: {n}")
        return 1 if applied else 0
    if a.dry_run:
        for _, original, token in sorted(dict.fromkeys(applied), key=lambda x: x[2]):
            print(f"{original} -> {token}")
        return 0
    if a.diff:
        for before, (after, _) in zip(texts, done, strict=True):
            sys.stdout.write(unified_diff(before, after))
        return 0
    code = _emit(a, names, [t for t, _ in done])
    if a.export_map:
        export_map(ledger, a.export_map)
    if a.save_session:
        store.save(ledger, a.save_session, a.session_ttl)
    if a.audit_log:
        audit(a.audit_log, audit_record("redact", applied, names))
    if a.v:
        print(json.dumps(ledger.highest, sort_keys=True), file=sys.stderr)
    return code


def _emit(a: argparse.Namespace, names: list[str], texts: list[str], private: bool = False) -> int:
    if a.output_dir:
        for out, t in zip(_outputs([Path(n) for n in names], a.output_dir), texts, strict=True):
            out.parent.mkdir(parents=True, exist_ok=True)
            write_private(out, t) if private else out.write_text(t, encoding="utf-8")
    elif a.output:
        write_private(Path(a.output), texts[0]) if private else Path(a.output).write_text(texts[0], encoding="utf-8")
    else:
        sys.stdout.write(texts[0])
    return 0


def _outputs(inputs: list[Path], folder: str) -> list[Path]:
    """Where each input's output goes: below the folder as the inputs lie below the parent that they share."""
    paths = [p.resolve() for p in inputs]
    common = Path(*_common([p.parent.parts for p in paths]))
    return [output_path(p, common, Path(folder)) for p in paths]


def _common(parts: list[tuple[str, ...]]) -> tuple[str, ...]:
    found = []
    for level in zip(*parts, strict=False):
        if len(set(level)) > 1:
            break
        found.append(level[0])
    return tuple(found)


__all__ = ["SessionError", "main"]

if __name__ == "__main__":
    sys.exit(main())
