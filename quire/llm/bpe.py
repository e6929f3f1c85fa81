"""Byte-level BPE ids of many texts at a time.

The words that BPE works on are found with numpy over all characters of a
batch, told apart by 64-bit hashes and lengths, and each different word goes
through the tokenizer's BPE model once per worker (a bounded cache). The ids equal those of ``Tokenizer.encode``; a text with a
character outside the blocks whose classes are certain goes to the tokenizer
whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from quire.llm.spans import WordHash, distinct

LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)
# Unicode's White_Space
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CERTAIN = [(0, 0x250), (0x391, 0x3CA), (0x410, 0x450), (0x2010, 0x2028), (0x4E00, 0x9FA6)]
CACHE_WORDS = 500_000
BATCH_CHARS = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself
    if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    out = np.full(0x110000, UNSURE, np.uint8)
    for lo, hi in _CERTAIN:
        out[lo:hi] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(lo, hi)]
    out[_SPACES] = SPACE
    return out


def word_starts(points: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start: ``points`` are the characters of texts laid end to
    end, ``cls`` their classes and ``first`` marks the first one of each text."""
    n = len(points)
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    # the last blank before a word belongs to the word if it is ' ', and else stands alone
    after = np.flatnonzero(start[1:] & ~first[1:] & (cls[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(cls[quote + 1] == LETTER) & ~first[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        two = quote + 2 < n
        b = np.where(two, points[np.minimum(quote + 2, n - 1)], 0)
        b[two & first[np.minimum(quote + 2, n - 1)]] = 0
        one = np.isin(a, [ord(c) for c in "stmd"])
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quote[one | pair] + 1] = False
        rest = np.concatenate([quote[one] + 2, quote[pair] + 3])
        start[rest[rest < n]] = True
    return start


class Encoder:
    """Encodes lists of texts; one per worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.classes = _classes()
        self.letters = _byte_letters()
        self.hash = WordHash()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        got = [[x.id for x in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        k = len(self.known)
        self.known.update(zip(words, range(k, k + len(words))))
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(g) for g in got], dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        todo: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if chars + len(t) > BATCH_CHARS and todo:
                self._some(texts, todo, out)
                todo, chars = [], 0
            if t:
                todo.append(i)
                chars += len(t)
        if todo:
            self._some(texts, todo, out)
        return out

    def _some(self, texts: list[str], todo: list[int], out: list[np.ndarray]) -> None:
        def arrays(rows):
            text = "".join(texts[i] for i in rows)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = np.fromiter((len(texts[i]) for i in rows), np.int64, len(rows))
            return text, points, self.classes[points], np.cumsum(sizes) - sizes

        text, points, cls, begins = arrays(todo)
        unsure = np.add.reduceat(cls == UNSURE, begins) > 0
        if unsure.any():
            for i, bad in zip(todo, unsure):
                if bad:
                    out[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            todo = [i for i, bad in zip(todo, unsure) if not bad]
            if not todo:
                return
            text, points, cls, begins = arrays(todo)
        first = np.zeros(len(points), bool)
        first[begins] = True
        at = np.flatnonzero(word_starts(points, cls, first))
        ends = np.append(at[1:], len(points))
        codes, one = distinct(self.hash(points, at, ends))
        words = [text[a:b] for a, b in zip(at[one].tolist(), ends[one].tolist())]
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self._forget()
            fresh = words
        if fresh:
            self._learn(fresh)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[codes]
        lo = self.ends[which]
        sizes = self.ends[which + 1] - lo
        stop = np.cumsum(sizes)
        ids = self.ids[np.arange(stop[-1]) + np.repeat(lo - (stop - sizes), sizes)]
        # the first word of each text
        cuts = (stop - sizes)[np.searchsorted(at, begins)]
        for i, piece in zip(todo, np.split(ids, cuts[1:])):
            out[i] = piece
