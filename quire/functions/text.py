"""Tokeniser as native Spark expressions (no UDF).

Tokens are maximal runs of Unicode letters and digits, lower-cased, with
accents removed: precomposed letters map to their base letter, stray combining
marks are dropped. Letters without a decomposition (``ß``, ``ø``) stay as they
are.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
MARKS = r"\p{M}+"


@functools.lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """(from, to) strings for ``translate``, built from the Unicode database:
    every BMP letter whose canonical decomposition is one base letter plus
    combining marks maps to that base letter."""
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if not unicodedata.category(ch).startswith("L"):
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold(col: Column) -> Column:
    """Lower-case and strip accents (texts of one byte a character have none)."""
    src, dst = accent_map()
    low = F.lower(col)
    plain = F.octet_length(low) == F.char_length(low)
    return F.when(plain, low).otherwise(F.regexp_replace(F.translate(low, src, dst), MARKS, ""))


def tokens(col: Column) -> Column:
    """array<string> of tokens of a text column (null text -> empty array)."""
    return F.array_remove(F.split(fold(F.coalesce(col, F.lit(""))), TOKEN_SPLIT), "")


def tokenize_py(text: str) -> list[str]:
    """Driver-side twin of :func:`tokens` for query strings (a few words)."""
    import regex

    src, dst = accent_map()
    folded = text.lower().translate(str.maketrans(src, dst))
    folded = regex.sub(r"\p{M}+", "", folded)
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", folded) if t]
