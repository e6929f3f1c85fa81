"""Words of many texts at a time, found and told apart with numpy."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHash:
    """64-bit hashes of many spans of one array at once: differences of a
    running polynomial, scaled back to the start of the span."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(symbols) + 1:
            self.up = _powers(_BASE, len(symbols) + 1)
            self.down = _powers(pow(_BASE, -1, 1 << 64), len(symbols) + 1)
        run = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[: len(symbols)], out=run[1:])
        h = (run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the values, and the first place of each different one."""
    codes, uniques = pd.factorize(values)
    first = np.zeros(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(values))[::-1]
    return codes, first


BATCH_CHARS = 1_000_000


@functools.lru_cache(maxsize=1)  # once a Python worker
def _word_characters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[: 0x3100] = [chr(c).isalnum() for c in range(0x3100)]
    out[0x3100:0x110000] = [chr(c).isalnum() for c in range(0x3100, 0x110000)]
    return out


class Words:
    """The words (runs of letters and digits, lower case) of a batch of texts.

    ``split`` yields, for slices of the texts with a bounded number of
    characters: the index of the first text, ``doc`` (per word, its text
    counted from there), ``code`` (per word, which of ``words`` it is),
    ``words`` (the different ones), and the words' first and end character
    within their text."""

    def __init__(self, keep: Callable[[], np.ndarray] = _word_characters):
        self.keep, self.hash = keep(), WordHash()

    def split(self, texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]]:
        for lo, hi, some in self._some(texts):
            yield (lo, hi, *self._slice(some))

    def _some(self, texts: list) -> Iterator[tuple[int, int, list[str]]]:
        lo = 0
        while lo < len(texts):
            hi, chars, some = lo, 0, []
            while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= BATCH_CHARS):
                t = texts[hi] if isinstance(texts[hi], str) else ""
                low = t.lower()
                # a few characters get longer in lower case; these stay, so that places hold
                some.append(low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t))
                chars += len(t)
                hi += 1
            yield lo, hi, some
            lo = hi

    def hashes(self, texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of the texts: first and end text, per word its text
        counted from the first, and the word's hash."""
        for lo, hi, some in self._some(texts):
            points, start, end, doc, _, _ = self._find(some)
            yield lo, hi, doc, self.hash(points, start, end)

    def _slice(self, texts: list[str]):
        points, start, end, doc, begins, text = self._find(texts)
        code, one = distinct(self.hash(points, start, end)) if len(start) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        words = [text[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        return doc, code, words, start - begins[doc], end - begins[doc]

    def _find(self, texts: list[str]):
        text = "\n".join(texts)  # never part of a word
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = self.keep[points]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        doc = np.searchsorted(begins, start, "right") - 1
        return points, start, end, doc, begins, text
