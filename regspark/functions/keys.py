"""Key expressions used by the registry joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_key(c, length: int = 7, width: int | None = None) -> Column:
    """First ``length`` characters of a key, as a string.

    Without ``width`` this is ``substring(cast(c as string), 1, length)``: an integer key
    is cast implicitly, so ``01234567`` read as the int 1234567 yields ``1234567``.  With
    ``width`` the key is left-padded with zeros to that width first, which restores the
    fixed-width form of zero-padded registry numbers.
    """
    s = _col(c).cast("string")
    if width is not None:
        s = _padded(s, width)
    return F.substring(s, 1, length)


def _padded(s: Column, width: int) -> Column:
    """Left-padded with zeros to ``width``; a longer key stays whole (``lpad`` would cut it)."""
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def padded_key(c, width: int = 8) -> Column:
    """Zero-padded string form of a numeric or string key; longer keys are kept."""
    return _padded(_col(c).cast("string"), width)
