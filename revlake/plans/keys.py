"""Driver-side helpers on keys and patterns."""

from __future__ import annotations

import re


def prefix_end(prefix: bytes) -> bytes | None:
    """The least byte string above every string with this prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def lex_next(key: bytes) -> bytes:
    """The next byte string in order."""
    return key + b"\0"


def glob_regex(pattern: str) -> str:
    """An anchored expression for ``*`` and ``?``; everything else is literal."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else _escape(c) for c in pattern) + "$"


def fuzzy_regex(pattern: str) -> str:
    """An expression for the pattern's characters in order, anything between."""
    return "(?s)" + ".*".join(map(_escape, pattern))


def _escape(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else "\\" + c


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def backoff_ms(base: int, attempt: int) -> int:
    return base * 2**attempt
