"""Randomness as a pure function of (key, seed), as SQL text.

md5 is used because its order is the same in every engine, so a sample can be
checked against plain SQL, and because it does not depend on partitioning.
"""

from __future__ import annotations

import math


def hash_hex(*parts: object) -> str:
    """md5 over SQL texts (or plain numbers) joined by a bar, as 32 hex digits."""
    return f"md5(concat_ws('|', {', '.join(f'CAST({p} AS STRING)' for p in parts)}))"


def hex_word(hexed: str, word: int = 0) -> str:
    """One of the four 32-bit words of a hash, as a non-negative BIGINT."""
    return f"CAST(conv(substring({hexed}, {8 * word + 1}, 8), 16, 10) AS BIGINT)"


def hex_wide(hexed: str) -> str:
    """60 bits of a hash as BIGINT, enough to spread draws over any table size."""
    return f"CAST(conv(substring({hexed}, 1, 15), 16, 10) AS BIGINT)"


def unit(hexed: str, word: int = 0) -> str:
    """Uniform double strictly between 0 and 1."""
    return f"(({hex_word(hexed, word)} + 0.5D) / 4294967296.0D)"


def normals(hexed: str) -> list[str]:
    """Four standard normal draws from one hash (two Box-Muller pairs)."""
    out = []
    for first in (0, 2):
        radius = f"sqrt(-2.0D * ln({unit(hexed, first)}))"
        angle = f"({2.0 * math.pi!r}D * {unit(hexed, first + 1)})"
        out += [f"({radius} * cos({angle}))", f"({radius} * sin({angle}))"]
    return out
