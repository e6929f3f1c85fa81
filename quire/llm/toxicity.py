"""Toxic passages as maximum-scoring segments, and a calibrated document score.

Learning. From labelled documents (copies once), the documents with a word are
counted by class and rolled up to features: the word itself and its 5-character pieces (which carry a stem
through its endings). A feature's log-odds ratio between the classes uses a
Dirichlet prior in proportion to its overall frequency, and features that lie
``MIN_Z`` standard deviations above zero make the model.

Scoring. A word scores the highest log-odds of its features, any other word a
small negative ``DRIFT``. One linear pass over the words finds all maximal
scoring segments (none can be made better by growing or cutting). Scores of
segments in unrelated text follow an extreme-value law, with ``lam`` and ``k``
fitted to the clean labelled documents, so a segment of score S in n words has
an expected number E = k n exp(-lam S) of equals by chance; segments with E
under ``MAX_E`` are significant passages. A document's evidence is the most
unlikely of the sums of its r best segments, and a logistic curve fitted to
the labelled documents turns that into a score from 0 to 1.

The classifier is fitted on a sample of at most about ``SAMPLE`` labelled rows
and holds every feature that significant there; all documents are scored whole.

Defined results: null and empty texts have no evidence and get the score of
that; several labels of one document count as its largest; without labelled
documents every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, last_stays, saved
from quire.llm.spans import Words

SAMPLE = 20_000
PIECE = 5
PRIOR = 0.5  # mass of the prior, in words of the toxic class
MIN_Z = 5.0
DRIFT = 0.3
MAX_E = 0.05
CACHE_WORDS = 300_000


@last_stays
def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fold."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    marks = saved(marks.where(fold("doc_id", 5) != 0), "toxic-marks")
    n = marks.count()
    kept = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < math.ceil(min(1.0, sample / max(n, 1)) * (1 << 20)))
    rows = docs.select("doc_id", "text").join(kept, "doc_id")
    rows = rows.select(F.coalesce("text", F.lit("")).alias("text"), (F.col("__toxic") > 0).cast("int").alias("toxic"))
    return saved(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-rows")  # copies count once


def learn_features(rows: DataFrame) -> dict[str, float]:
    """{feature: log-odds} of the significant toxic features."""
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    words = rows.select("toxic", word).where("word <> ''").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")
    )
    pieces = F.when(
        F.length("word") > PIECE,
        F.transform(F.sequence(F.lit(1), F.length("word") - PIECE + 1), lambda i: F.substring("word", i, F.lit(PIECE))),
    ).otherwise(F.array().cast("array<string>"))
    whole = F.array(F.concat(F.lit("="), "word"))
    found = words.select(F.explode(F.array_distinct(F.concat(whole, pieces))).alias("f"), "t", "c")
    found = found.groupBy("f").agg(F.sum("t").cast("double").alias("t"), F.sum("c").cast("double").alias("c"))
    n = words.agg(F.sum("t").cast("double").alias("nt"), F.sum("c").cast("double").alias("nc")).first()
    if not n["nt"] or not n["nc"]:
        return {}
    nt, nc = n["nt"], n["nc"]
    mass = PRIOR * nt
    prior = (F.col("t") + F.col("c")) / (nt + nc) * mass
    odds = lambda y, total: F.log((y + prior) / F.greatest(total + mass - y - prior, F.lit(1.0)))
    scored = found.withColumn("w", odds(F.col("t"), nt) - odds(F.col("c"), nc)).withColumn(
        "z", F.col("w") / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    )
    best = scored.where(F.col("z") >= MIN_Z).where("w > 1")
    return {r["f"]: r["w"] for r in best.select("f", "w").collect()}


def segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a text whose words score ``scores`` at
    the places ``at`` and ``-drift`` elsewhere: (first, last word, score).

    Linear: a stack holds the candidates with the running total before and
    after each; a new one joins back over those it can improve on."""
    stack: list[list] = []  # first word, last word, total before, total after
    total, last = 0.0, -1
    for i, s in zip(at, scores):
        total -= drift * (i - last - 1)
        new = [i, i, total, total + s]
        total, last = total + s, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                # nothing to gain by reaching back
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


class Scanner:
    """Finds the segments of texts; one per worker."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.words, self.cache = weights, Words(), {}

    def word(self, w: str) -> float:
        get = self.weights.get
        best = get("=" + w, 0.0)
        for i in range(len(w) - PIECE + 1 if len(w) > PIECE else 0):
            best = max(best, get(w[i : i + PIECE], 0.0))
        return best

    def __call__(self, texts: list) -> Iterator[tuple[int, list]]:
        """For each text its number of words and its segments
        (first character, end character, score)."""
        for lo, hi, doc, code, words, start, end in self.words.split(texts):
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            cache = self.cache
            for w in words:
                if w not in cache:
                    cache[w] = self.word(w)
            score = np.fromiter((cache[w] for w in words), float, len(words))[code]
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            hits = np.flatnonzero(score > 0)
            cuts = np.searchsorted(hits, first)
            for k in range(hi - lo):
                own = hits[cuts[k] : cuts[k + 1]]
                found = segments(own.tolist(), score[own].tolist(), DRIFT) if len(own) else []
                yield int(first[k + 1] - first[k]), [(int(start[a]), int(end[b]), s) for a, b, s in found]


def evidence(n: int, scores: list[float], lam: float, k: float) -> float:
    """-log of the chance of the least likely sum of the r best segments."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += max(0.0, lam * s - math.log(max(k * n, 1e-9)))
        if total > 0:
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
    return min(best, 700.0)


def fit_law(n_words: float, scores: list[float]) -> tuple[float, float]:
    """lam and k from the segments of clean text: above their smallest score
    they fall off exponentially, at a rate of 1 / (mean excess)."""
    floor = min(scores, default=1.0)
    excess = sum(s - floor for s in scores) + 1.0  # one pseudo segment
    lam = (len(scores) + 1) / excess
    lam = min(lam, 2.0)
    return lam, (len(scores) + 0.5) / max(n_words, 1.0) * math.exp(lam * floor)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x, with a weak ridge."""
    z = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    rows = training_rows(docs, labels)
    weights = learn_features(rows)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for b in batches:
            got = list(scanner(b["text"].tolist()))
            yield pd.DataFrame({"toxic": b["toxic"], "n": [n for n, _ in got], "s": [[x[2] for x in f] for _, f in got]})

    # at most about SAMPLE rows
    got = rows.mapInPandas(scan, "toxic int, n long, s array<double>").collect()
    if not got:
        return {"weights": {}, "lam": 1.0, "k": 1.0, "curve": None}
    clean = [r for r in got if not r["toxic"]]
    lam, k = fit_law(sum(r["n"] for r in clean), [s for r in clean for s in r["s"]])
    x = np.array([math.log1p(evidence(r["n"], r["s"], lam, k)) for r in got])
    return {"weights": weights, "lam": lam, "k": k, "curve": fit_curve(x, np.array([r["toxic"] for r in got], float))}


def scorer(spark, model: dict):
    """A column function text -> struct(score, passages)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score: double, passages: array<struct<first: int, end: int, score: double, expected: double>>>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        lam, k = m["lam"], m["k"]
        scanner = Scanner(m["weights"])
        for texts in parts:
            scores, passages = [], []
            for n, found in scanner(texts.tolist()):
                scores.append(math.log1p(evidence(n, [s for _, _, s in found], lam, k)))
                expected = [(a, b, s, k * n * math.exp(-min(lam * s, 700))) for a, b, s in found]
                passages.append([p for p in expected if p[3] <= MAX_E])
            a, b = m["curve"] or (0.0, 0.0)
            p = 1 / (1 + np.exp(-np.clip(a + b * np.array(scores, float), -30, 30))) if m["curve"] else np.zeros(len(scores))
            yield pd.DataFrame({"score": p, "passages": passages})

    return score


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score under 0.5."""
    score = scorer(spark, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text"))["score"] < 0.5)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    score = scorer(spark, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score("text").alias("s")).select(
        "doc_id",
        "held_out",
        F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
        F.size("s.passages").alias("n_passages"),
    )
