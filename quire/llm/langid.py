"""Languages of texts, word by word.

Learning. A model holds, per language, the log-probabilities of the character
trigrams of its words (with their edges), in ``SLOTS`` hashed slots, and the
shares of the scripts its letters come from. It is learned from the words of at
most about ``SAMPLE`` documents a language (copies once).

Labelling. The script of a word's first letter narrows its candidates to the
languages that use the script (all, if none does); each candidate scores the
sum of the word's trigrams. Viterbi then labels the words of a text so that the
sum of scores, less ``SWITCH`` for every change of language, is highest. Most
texts need no search: if no stretch of words gains ``SWITCH`` by leaving the
best single language, that language is the best path. The spans of one
language are the result; the language with most letters is the document's, and
its share of the letters the score.

Defined results: null texts and texts without a letter are ``und`` with score
0; without training documents everything is ``und``; ties go to the language
that comes first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, saved
from quire.llm.spans import Words

SAMPLE = 3000
SLOTS = 1 << 16
SWITCH = 12.0
SHARE = 0.01
# first code points of scripts (Unicode blocks); a script reaches to the next entry
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Bopomofo"),
    (0x3130, "Hangul"), (0x3190, "Kana"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "other"), (0x20000, "Han"),
]
_FROM = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODE = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _CODE[np.searchsorted(_FROM, points, "right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the trigrams of words, where each word's begin, and the
    scripts of the words' first letters."""
    text = "\2" + "\3\2".join(words) + "\3"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 2) - (size + 2)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(len(h), bool)
    edge = begin[1:]
    inside[edge - 1] = False  # across two words
    inside[edge - 2] = False
    slots = (h >> np.uint64(40)).astype(np.int64)[inside] % SLOTS
    return slots, np.cumsum(size) - size, scripts_of(points[begin + 1])


def training_rows(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of the documents to learn from."""
    rows = docs.where("lang is not null and text is not null").where(fold("doc_id", 4) != 2)
    size = saved(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "lang-sizes")
    rows = rows.select("lang", "text", "doc_id").join(size, "lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return saved(rows.where(draw * F.col("__n") < sample).select("lang", "text").distinct(), "lang-rows")


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Words(letters)
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            lang = b["lang"].to_numpy()
            for lo, hi, doc, code, words, _, _ in split.split(b["text"].tolist()):
                if not len(words):
                    continue
                slots, begin, script = grams(words)
                size = np.diff(np.r_[begin, len(slots)])
                for name in set(lang[lo:hi]):
                    own = counts.setdefault(name, np.zeros(SLOTS + len(_NAMES)))
                    n = np.bincount(code[lang[lo:hi][doc] == name], minlength=len(words)).astype(float)
                    own[:SLOTS] += np.bincount(slots, np.repeat(n, size), SLOTS)
                    own[SLOTS:] += np.bincount(script, n, len(_NAMES))
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "slot": at, "n": own[at].astype(np.int64)})

    rows = training_rows(docs, sample).mapInPandas(run, "lang string, slot long, n long")
    # SLOTS numbers a language at most
    got = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got["lang"].unique())
    table = np.zeros((len(names), SLOTS + len(_NAMES)))
    for i, name in enumerate(names):
        own = got[got["lang"] == name]
        table[i, own["slot"]] = own["n"]
    count, script = table[:, :SLOTS], table[:, SLOTS:]
    logp = np.log((count + 0.1) / (count.sum(1, keepdims=True) + 0.1 * SLOTS)) if names else count
    uses = script >= SHARE * np.maximum(script.sum(1, keepdims=True), 1)
    return {"names": names, "logp": np.ascontiguousarray(logp.T.astype(np.float32)), "uses": uses}


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best label sequences of several texts (words x languages), all texts
    one step at a time, longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order])
    steps, langs = size[0], scores[0].shape[1]
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = np.concatenate([scores[i] for i in order])
    back = np.zeros((len(flat), langs), np.int8 if langs < 128 else np.int32)
    own = np.arange(langs)
    live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")  # texts with that many words
    value = flat[at].copy()
    for t in range(1, steps):
        k = live[t]
        value_k = value[:k]
        best = value_k.argmax(1)
        jump = value_k[np.arange(k), best] - switch
        stay = value_k >= jump[:, None]
        rows = at[:k] + t
        back[rows] = np.where(stay, own, best[:, None])
        value[:k] = np.where(stay, value_k, jump[:, None]) + flat[rows]
    label = value.argmax(1)
    path = np.zeros(len(flat), np.int64)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        rows = at[:k] + t
        path[rows] = label[:k]
        if t:
            label[:k] = back[rows, label[:k]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for j, i in enumerate(order):
        out[i] = path[at[j] : at[j] + size[j]]
    return out


def labels(doc: np.ndarray, score: np.ndarray, docs: int, switch: float) -> np.ndarray:
    """The label of every word; words of a text are adjacent."""
    n, langs = score.shape
    first = np.searchsorted(doc, np.arange(docs + 1))
    run = np.vstack([np.zeros((1, langs)), np.cumsum(score, 0, dtype=float)])
    total = run[first[1:]] - run[first[:-1]]
    best = total.argmax(1)
    path = best[doc]
    if langs == 1:
        return path
    gain = score.max(1) - score[np.arange(n), path]
    # most any stretch of words gains: highest rise of the running sum, text by text
    after = np.cumsum(gain)
    before = after - gain
    apart = 2.0 * (after[-1] + 1.0)
    low = np.minimum.accumulate(before - apart * doc) + apart * doc
    rise = np.zeros(docs)
    np.maximum.at(rise, doc, after - low)
    hard = [i for i in np.flatnonzero(rise > switch - 0.5) if first[i + 1] > first[i]]
    if hard:
        for i, p in zip(hard, viterbi([score[first[i] : first[i + 1]] for i in hard], switch)):
            path[first[i] : first[i + 1]] = p
    return path


def labeller(spark, model: dict):
    """A column function text -> struct(lang, score, spans)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: string, score: double, spans: array<struct<first: int, end: int, lang: string>>>")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names, split = m["names"], Words(letters)
        for texts in parts:
            lang, share, spans = [], [], []
            for lo, hi, doc, code, words, start, end in split.split(texts.tolist()):
                k = hi - lo
                if not len(words) or not names:
                    lang += ["und"] * k
                    share += [0.0] * k
                    spans += [[] for _ in range(k)]
                    continue
                slots, begin, script = grams(words)
                score = np.add.reduceat(m["logp"][slots], begin, axis=0).astype(float)
                open_to = m["uses"][:, script].T
                open_to |= ~open_to.any(1, keepdims=True)
                score = np.where(open_to, score, score.min() - 1e3)
                path = labels(doc, score[code], k, SWITCH)
                size = end - start
                weight = np.bincount(doc * len(names) + path, size, k * len(names)).reshape(k, len(names))
                total = weight.sum(1)
                win = weight.argmax(1)
                change = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])])
                last = np.r_[change[1:], len(doc)] - 1
                own: list[list] = [[] for _ in range(k)]
                for a, z in zip(change.tolist(), last.tolist()):
                    own[doc[a]].append((int(start[a]), int(end[z]), names[path[a]]))
                lang += [names[w] if t else "und" for w, t in zip(win, total)]
                share += [float(weight[i, w] / t) if t else 0.0 for i, (w, t) in enumerate(zip(win, total))]
                spans += own
            yield pd.DataFrame({"lang": lang, "score": share, "spans": spans})

    return label


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    label = labeller(spark, learn(docs))
    return docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), label("text").alias("s")).select(
        "doc_id",
        "held_out",
        F.col("s.lang").alias("lang_pred"),
        F.col("s.score").alias("score"),
        F.size("s.spans").alias("n_spans"),
    )
