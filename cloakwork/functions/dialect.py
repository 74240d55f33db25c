"""Python regular expressions in the form that Spark's regex functions (java.util.regex) take."""

from __future__ import annotations

import re


def to_java(pattern: str) -> str:
    """The same expression for Java: Unicode classes, \\n as the only line end, Java's names for groups and end of text."""
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", named)
    return "(?U)(?d)" + named.replace(r"\Z", r"\z")


def group_number(pattern: str, name: str) -> int:
    """The number of a named group, for functions that know numbers only."""
    return re.compile(pattern).groupindex[name]
