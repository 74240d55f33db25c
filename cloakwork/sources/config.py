"""Settings: TOML layers for which rules run, engagement targets, custom rules and allowed values."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from ..operators import rules as R
from ..operators.redact import Policy

# fixed values
PROFILES = {"pentest": {"ntlm_hash_bare": True}}
TARGET_LISTS = {"hostnames": "hostname", "usernames": "username", "netbios": "netbios", "shares": "share"}
CUSTOM_KEYS = frozenset({"values", "values_nocase", "target_domains", "allowlist", "patterns", *TARGET_LISTS})
TABLES = frozenset({"default_profile", "rules", "llm", "audit", "ask", "custom", "profiles"})


class ConfigError(ValueError):
    pass


def load(path: str | Path) -> dict:
    """An absent file is an empty configuration."""
    p = Path(path)
    if not p.exists():
        return {}
    try:
        return tomllib.loads(p.read_text(encoding="utf-8"))
    except (OSError, UnicodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{p}: {e}") from e


def init(path: str | Path) -> None:
    """A first file, readable by the owner only; an existing one is an error."""
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write("[rules]\n# all = true\n\n[custom]\nvalues = []\ntarget_domains = []\nallowlist = []\n")


def _strings(table: dict, key: str) -> list[str]:
    found = table.get(key, [])
    if not isinstance(found, list) or not all(isinstance(v, str) and v.strip() for v in found):
        raise ConfigError(f"{key} must be a list of non-empty strings")
    return found


def _switches(layer: object, names: set[str], what: str) -> dict[str, bool]:
    if not isinstance(layer, dict):
        raise ConfigError(f"{what} must be a table")
    for k, v in layer.items():
        if k != "custom_values_extra" and (k not in names | {"all"} or not isinstance(v, bool)):
            raise ConfigError(f"{what}: {k} must be a rule's name (or all) with true or false")
    switches = {k: v for k, v in layer.items() if isinstance(v, bool)}
    return ({n: switches["all"] for n in names} if "all" in switches else {}) | {k: v for k, v in switches.items() if k != "all"}


def policy(config: dict, profile: str | None = None, on: list[str] = (), off: list[str] = ()) -> Policy:  # type: ignore[assignment]
    """The layers in order: [rules], the built-in profile, the user's profile, what the command line says; in a layer `all` comes first.
    Custom rules come after the switches, so `all` doesn't touch them."""
    if unknown := set(config) - TABLES:
        raise ConfigError(f"unknown tables: {', '.join(sorted(unknown))}")
    base = R.built_in()
    names = {r.name for r in base}
    layers = [_switches(config.get("rules", {}), names, "rules")]
    profile = profile or config.get("default_profile")
    profiles = config.get("profiles", {})
    if profile and profile != "standard" and profile not in PROFILES and profile not in profiles:
        raise ConfigError(f"unknown profile: {profile}")
    layers += [PROFILES.get(profile or "", {}), _switches(profiles.get(profile, {}), names, f"profiles.{profile}")]
    state = {r.name: r.enabled for r in base}
    for layer in layers:
        state |= layer
    if unknown := (set(on) | set(off)) - names:
        raise ConfigError(f"unknown rules: {', '.join(sorted(unknown))}")
    state |= dict.fromkeys(on, True) | dict.fromkeys(off, False)
    base = R.switched(base, [n for n, s in state.items() if s], [n for n, s in state.items() if not s])
    custom = config.get("custom", {})
    if not isinstance(custom, dict) or set(custom) - CUSTOM_KEYS:
        raise ConfigError("custom must be a table of known lists")
    extra = [*R.custom_values(_strings(custom, "values")), *R.custom_values(_strings(custom, "values_nocase"), False)]
    for p in custom.get("patterns", []):
        if not isinstance(p, dict) or not {"name", "pattern"} <= set(p) <= {"name", "pattern", "replacement"}:
            raise ConfigError("a custom pattern has a name, a pattern and perhaps a replacement")
        try:
            extra.append(R.custom_pattern(p["name"], p["pattern"], *([p["replacement"]] if "replacement" in p else [])))
        except Exception as e:
            raise ConfigError(f"custom pattern {p['name']!r}: {e}") from e
    extra += R.target_domains(_strings(custom, "target_domains"))
    for key, kind in TARGET_LISTS.items():
        extra += R.targets(kind, _strings(custom, key))
    extra += R.custom_values(_strings(profiles.get(profile, {}) if profile else {}, "custom_values_extra"))
    return Policy(tuple(R.in_order([*base, *extra])), tuple(_strings(custom, "allowlist")))


def read_targets(text: str) -> list[R.Rule]:
    """Lines `kind:value`; # begins a comment line."""
    found: list[R.Rule] = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        kind, mark, value = (x.strip() for x in line.partition(":"))
        if not mark or not value or kind not in ("domain", *R.TARGET_KINDS):
            raise ConfigError(f"line {n}: expected kind:value with one of domain, {', '.join(R.TARGET_KINDS)}")
        found += R.targets(kind, [value])
    return found
