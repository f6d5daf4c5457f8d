"""Window strings such as ``30s``, ``5m``, ``1h``, ``1d`` and ``1w``."""

from __future__ import annotations

import re

# The suffixes and what they stand for, and the length without one.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
DEFAULT = 3600


def parse_window(text: str) -> int:
    """Seconds of a window string; 3600 without a known suffix, an error for a malformed number."""
    number, unit = re.fullmatch(rf"(.*?)([{''.join(SECONDS)}]?)", text, re.DOTALL).groups()
    return int(number) * SECONDS[unit] if unit else DEFAULT


def interval(text: str) -> str:
    """The same as a Spark interval string."""
    return f"{parse_window(text)} seconds"
