"""Models behind a local HTTP address or a command: callables from a prompt to an answer. Nothing here looks at what is sent."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import urllib.request
from collections.abc import Callable

from ..operators.safety import is_loopback


class ProviderError(RuntimeError):
    pass


def local_model(host: str, model: str, *, system: str = "", max_tokens: int = 4096, timeout: float = 300, structured: bool = False, allow_remote: bool = False) -> Callable[[str], str]:
    """A model that a server at `host` runs. An address that isn't this machine's must be allowed."""
    if not is_loopback(host) and not allow_remote:
        raise ProviderError(f"{host} is not this machine; it must be allowed")

    def ask(prompt: str) -> str:
        body = {"model": model, "prompt": prompt, "system": system, "stream": False, "options": {"num_predict": max_tokens}} | ({"format": "json"} if structured else {})
        request = urllib.request.Request(f"{host.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                found = json.load(answer)
        except (OSError, ValueError) as e:
            raise ProviderError(f"no answer from {host}: {e}") from e
        if not isinstance(found, dict) or not isinstance(found.get("response"), str) or not found["response"].strip():
            raise ProviderError("an answer without text")
        return found["response"]

    return ask


def command(argv: list[str], *, timeout: float = 600, isolated: bool = True, keep: tuple[str, ...] = ("PATH", "HOME", "LANG", "TERM", "USER")) -> Callable[[str], str]:
    """A program that reads the prompt from its input. Isolated, it starts in an empty folder and sees only the named variables."""

    def ask(prompt: str) -> str:
        with tempfile.TemporaryDirectory() as folder:
            env = {k: v for k, v in os.environ.items() if k in keep} if isolated else None
            try:
                done = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout, cwd=folder if isolated else None, env=env, check=False)
            except (OSError, subprocess.TimeoutExpired) as e:
                raise ProviderError(f"{argv[0]}: {e}") from e
        if done.returncode or not done.stdout.strip():
            raise ProviderError(f"{argv[0]} ended with {done.returncode} and {'no' if not done.stdout.strip() else 'an'} answer")
        return done.stdout

    return ask
