"""PySpark-native sanitization of sensitive text, and operators for training-data pipelines."""

from .operators.ledger import Ledger
from .operators.redact import Policy, redact_documents, redact_text
from .operators.restore import restore_documents, restore_text

__version__ = "0.1.0"


def sanitize(text: str, policy: Policy | None = None) -> tuple[str, dict[str, str]]:
    """A text's redacted form, and its map from token to original."""
    policy = policy or Policy()
    ledger = policy.ledger()
    return redact_text(text, policy, ledger)[0], ledger.originals()


def desanitize(text: str, originals: dict[str, str]) -> str:
    """The originals put back."""
    if not isinstance(text, str) or not isinstance(originals, dict) or not all(isinstance(x, str) for pair in originals.items() for x in pair):
        raise TypeError("desanitize takes a text and a map from token to original")
    return restore_text(text, originals)[0]


__all__ = ["Ledger", "Policy", "desanitize", "redact_documents", "redact_text", "restore_documents", "restore_text", "sanitize"]
