"""Asking a model about a sanitized document: settings, what is said before anything leaves, and the loop from redaction to the restored answer.

Models are callables from a prompt to an answer (see ``cloakwork.sources.providers``). Everything before the sending has a form for DataFrames too.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redact import Policy, redact_text, redact_values
from .restore import restore_text
from .safety import is_remote, scan, warnings

# fixed values
PROVIDERS = ("claude", "claude-code", "codex", "ollama", "openai")
MODES = ("isolated", "standard")
WARN_CHARS = 50_000


@dataclass(frozen=True)
class Settings:
    provider: str = "claude"
    model: str | None = None
    host: str = "http://localhost:11434"
    max_tokens: int = 16_000
    mode: str = "isolated"
    timeout: int = 600
    warn_chars: int = WARN_CHARS

    @property
    def remote(self) -> bool:
        return is_remote(self.provider, self.host)


def settings(config: dict, provider: str | None = None, model: str | None = None) -> Settings:
    """What the call says comes first, then the table [ask] (its model for this provider before its general one), then the defaults."""
    own = config.get("ask", {})
    if not isinstance(own, dict):
        raise ValueError("ask must be a table")
    provider = provider or own.get("provider") or Settings.provider
    models = own.get("models", {})
    of_provider = models.get(provider) if isinstance(models, dict) else None
    found = Settings(provider, model or of_provider or own.get("model"), own.get("host", Settings.host), own.get("max_tokens", Settings.max_tokens), own.get("cli_mode", Settings.mode), own.get("timeout_seconds", Settings.timeout), own.get("warn_chars", WARN_CHARS))
    return checked(found)


def checked(s: Settings) -> Settings:
    """The settings; ValueError says which of them can't be used."""
    if s.provider not in PROVIDERS:
        raise ValueError(f"unknown provider {s.provider!r}: one of {', '.join(PROVIDERS)}")
    if s.model is not None and (not isinstance(s.model, str) or not s.model.strip()):
        raise ValueError("the model must be a non-empty string")
    if not isinstance(s.host, str) or not s.host.strip():
        raise ValueError("the host must be a non-empty string")
    if s.mode not in MODES:
        raise ValueError(f"the mode must be one of {', '.join(MODES)}")
    for name in ("max_tokens", "timeout"):
        if type(getattr(s, name)) is not int or getattr(s, name) <= 0:
            raise ValueError(f"{name} must be a positive integer")
    return s


def build_prompt(question: str, document: str) -> str:
    return f"{question}\n\n---\n{document}\n---" if document.strip() else question


def digest(prompt: str) -> str:
    """What a person who approves a prompt can compare: SHA-256 of its UTF-8 bytes."""
    return hashlib.sha256(prompt.encode()).hexdigest()


def size_warning(document: str, most: int = WARN_CHARS) -> str | None:
    if most <= 0 or len(document) <= most:
        return None
    return f"{len(document):,} characters, about {len(document) // 4:,} tokens: more than the model may take, or cheap"


def prompt_column(question: Column, document: Column) -> Column:
    """build_prompt in Spark's functions."""
    blank = F.regexp_replace(document, r"(?U)\s+", "") == ""
    return F.when(blank, question).otherwise(F.concat(question, F.lit("\n\n---\n"), document, F.lit("\n---")))


def digest_column(prompt: Column) -> Column:
    return F.sha2(F.encode(prompt, "UTF-8"), 256)


def tokens_warned(document: Column, most: int = WARN_CHARS) -> Column:
    """The estimated tokens of a document that size_warning warns of, else null."""
    return F.when((F.lit(most) > 0) & (F.length(document) > most), F.floor(F.length(document) / 4).cast("long"))


@dataclass
class Preflight:
    """What a prompt still holds: possible identifiers by kind, surely credentials by category, and whether it must not leave."""

    warned: dict[str, int] = field(default_factory=dict)
    found: dict[str, int] = field(default_factory=dict)
    blocked: bool = False
    forced: bool = False


def preflight(prompt: str, originals: list[str] | tuple[str, ...] = (), *, remote: bool = True, force: bool = False, preview: bool = False) -> Preflight:
    """A model on this machine is asked anyway. A preview is never forced: nothing leaves, so it says what is wrong."""
    if not remote:
        return Preflight()
    found = dict(sorted(Counter(c for c, _, _ in scan(prompt)).items()))
    forced = bool(found) and force and not preview
    return Preflight(dict(sorted(warnings(prompt, originals).items())), found, bool(found) and not forced, forced)


class Blocked(RuntimeError):
    pass


class Declined(RuntimeError):
    pass


def united(first: list[tuple[str, str, str]], second: list[tuple[str, str, str]], kinds: frozenset[str]) -> dict[str, set[str]]:
    """The values of these kinds that either side replaced: what one side decided to redact, both must."""
    out: dict[str, set[str]] = {}
    for category, original, _ in [*first, *second]:
        if category in kinds:
            out.setdefault(category, set()).add(original)
    return out


def ask_safely(
    question: str, document: str, policy: Policy, send: Callable[[str], str] | None, *, remote: bool = True, force: bool = False, approve: Callable[[str, str], bool] | None = None,
    warn: Callable[[str], None] | None = None, audit: Callable[[str, list], None] | None = None,
) -> str:
    """Redacts document and question in one scope, looks at what would leave, lets `approve` see the exact prompt and its digest, writes the audit record,
    sends, and restores the answer. Without `send` nothing leaves and the prompt is returned (a preview)."""
    if not isinstance(question, str) or not question.strip() or not isinstance(document, str):
        raise ValueError("a question must be a non-empty string, a document a string")
    ledger = policy.ledger()
    document, log = redact_text(document, policy, ledger)
    question, more = redact_text(question, policy, ledger)
    names = frozenset(r.name for r in policy.rules)
    both = united(log, more, names)
    (document, again), (question, also) = redact_values(document, policy, ledger, both), redact_values(question, policy, ledger, both)
    log += more + again + also
    prompt = build_prompt(question, document)
    look = preflight(prompt, tuple(k for k, t in ledger.token_of.items() if k != t), remote=remote, force=force, preview=send is None)
    if warn:
        for text in filter(None, [size_warning(document), "possible identifiers remain: " + ", ".join(f"{k}={n}" for k, n in look.warned.items()) if look.warned else None]):
            warn(text)
    if look.blocked:
        raise Blocked("credentials remain: " + ", ".join(f"{k}={n}" for k, n in look.found.items()))
    if send is None:
        return prompt
    if approve and not approve(prompt, digest(prompt)):
        raise Declined("not approved; nothing was sent")
    if audit:
        audit("forced_attempt" if look.forced else "attempted", log)
    return restore_text(send(prompt), ledger.originals())[0]


__all__ = ["Blocked", "Declined", "Preflight", "Settings", "ask_safely", "build_prompt", "checked", "digest", "digest_column", "preflight", "prompt_column", "replace", "settings", "size_warning", "tokens_warned", "united"]
