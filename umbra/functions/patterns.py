"""Regular expressions of the detectors and classifiers.

``(?U)`` keeps word boundaries and classes Unicode-aware whatever the JDK; the
classifier's patterns are ASCII and spell their boundary out.
"""

# Patterns, in the order that breaks ties between equal spans.
_END = r"""[^\s)\]}>"',`<]+"""
SPANS = (
    ("URL", rf"https?://{_END}"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PATH", rf"/(?:Users|home|tmp|var|opt|etc|usr)/{_END}"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
)
PSEUDONYM = r"\b(EMAIL|PATH|IP|URL|UUID|PERSON|LOCATION|ORG|PII)_\d+\b"
OPEN_PSEUDONYM = r"\b([A-Z][A-Z0-9]*)_(\d+)\b"
GATE = r"[A-Z][A-Z0-9]*_[0-9]+"
HONORIFIC = r"^(?:dr\.?|mr\.?|mrs\.?|ms\.?|prof\.?|miss)\s+"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
FRONT = r"(?im)^---[\s\S]*?\n\s*sensitivity\s*:\s*{}\s*\n[\s\S]*?---"
ENV = r"""(?m)(?:^|\s)(?:export\s+)?[A-Z][A-Z0-9_]{2,}=\s*["']?[^\s"'\n]{6,}"""
KEYS = r"(?:sk-[A-Za-z0-9_-]{20,}|pk_[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{30,}|AKIA[0-9A-Z]{16}|[A-Za-z0-9_-]{40,})"
API_KEY = _EDGE + KEYS + _EDGE


def unicode(pattern: str) -> str:
    return "(?U)" + pattern
