"""Exact highest inner products by pivot-table elimination.

Distances of every vector to ``PIVOTS`` pivots are stored beside it. By the
triangle inequality, the largest difference of the distances of a query and a
candidate to the same pivot is a lower bound of their own distance, and with
both lengths that is an upper bound of their inner product. Candidates are
evaluated in the order of that bound, in growing portions, until the next bound
is below the worst of the best so far (equal ones still count: ties go to
smaller ids). Queries and candidates meet in blocks; a window per query then
merges the blocks.

Components are floor(256 x), scores exact integers (64 bit; beyond that they
stay at the largest). Pivots are chosen far apart from a sample of at most
``SAMPLE`` vectors; that changes the order of work only.

Defined results: vectors that are null or hold a null or non-finite component
take no part; empty vectors have score 0, and a shorter vector counts as
followed by zeros; every row is a candidate of its own, also with a repeated
id, and each query row has its own ranks; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.vectors import best_of, keep, matrix, meet, prepared

TOP = 5
EVERY = 50
PIVOTS = 32
SAMPLE = 1024
BLOCK, QUERIES = 16_384, 1024


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the sample vector farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of one row with many, exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(len(a), 1)
    if top < 2**53:
        return (b.astype(float) @ a.astype(float)).astype(np.int64)
    if top < 2**62:
        return b @ a
    exact = b.astype(object) @ a.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


def search_block(q: np.ndarray, qd: np.ndarray, x: np.ndarray, xd: np.ndarray, skip: int, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best rows of ``x`` for ``q``, without row
    ``skip``, by pivot distances ``qd`` and ``xd``."""
    q2, x2 = float((q.astype(float) ** 2).sum()), (x.astype(float) ** 2).sum(1)
    lower = np.abs(xd - qd).max(1) if xd.shape[1] else np.zeros(len(x))
    bound = np.minimum((q2 + x2 - lower * lower) / 2, np.sqrt(q2 * x2))
    bound += 1e-9 * (q2 + x2) + 1.0  # more than rounding can do
    if skip >= 0:
        bound[skip] = -np.inf
    order = np.argsort(-bound, kind="stable")[: len(x) - (skip >= 0)]
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, step = 0, 64
    while at < len(order):
        if len(scores) >= top and bound[order[at]] < scores.min():
            break
        part = order[at : at + step]
        places, scores = np.r_[places, part], np.r_[scores, products(q, x[part])]
        best = best_of(ids[places], scores, top)
        places, scores = places[best], scores[best]
        at, step = at + step, step * 2
    return places, scores


def exact_top(vectors: DataFrame, top: int = TOP, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    table = keep(prepared(vectors, whole, every), "top-vectors")
    width = table.agg(F.max(F.size("v"))).first()[0] or 0
    sample = table.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("v").toPandas()["v"]
    shared = table.sparkSession.sparkContext.broadcast(choose_pivots(matrix(sample, width, float), pivots))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for b in batches:
            x = matrix(b["v"], width, float)
            b["d"] = [np.sqrt(((p - row) ** 2).sum(1)) for row in x]
            yield b

    table = keep(table.mapInPandas(measure, "vec_id long, v array<long>, asks boolean, rid long, d array<double>"), "top-pivots")

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(x):
            count = len(shared.value)
            qv, xv = matrix(q["v"], width, np.int64), matrix(x["v"], width, np.int64)
            qd, xd = matrix(q["d"], count, float), matrix(x["d"], count, float)
            ids, own = x["vec_id"].to_numpy(), dict(zip(x["rid"], range(len(x))))
            for i, (rid, qid) in enumerate(zip(q["rid"], q["vec_id"])):
                places, scores = search_block(qv[i], qd[i], xv, xd, own.get(rid, -1), ids, top)
                rows += [(rid, qid, x["vec_id"].iat[p], s) for p, s in zip(places, scores.tolist())]
        return pd.DataFrame(rows, columns=["qrid", "query_id", "vec_id", "score"])

    return meet(table, ["d"], search, top, "long", block, queries)


def op2_exact_top(spark, sf_dir: str) -> DataFrame:
    return exact_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = f"""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % {EVERY} = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}"""
