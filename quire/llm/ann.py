"""Approximate nearest neighbours by collision-counting hashing.

A hash is one random projection. A block of vectors is indexed by the sorted
array of each projection. A query opens a window around its own value in every
array; a vector inside counts a collision. If too few vectors have collided in
``NEED`` of all projections, the windows widen by ``WIDER`` (virtual rehashing:
the arrays stay, only the part added to a window is counted) until there are
``LEAST`` plus ``SHARE`` of the block. These are verified by their exact inner
product; the others are not looked at.

Nearness is the largest inner product. For the hashes, a component is added
that makes all vectors equally long and is 0 for queries, so that the nearest
by distance are the largest by inner product. All rows are indexed.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part; a shorter vector counts as followed by zeros; every row
is a candidate of its own, also with a repeated id, and each query row has its
own ranks; null ids come last. Vectors are hashed in units of the largest
component, so that squares neither overflow nor vanish; a product beyond the
range of doubles is infinite, and one that is no number counts as minus infinity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.vectors import best_of, keep, matrix, meet, prepared

TOP = 20
EVERY = 20
HASHES = 64
NEED = 0.6
START, WIDER = 0.5, 1.25
LEAST, SHARE = 600, 0.12
BLOCK, QUERIES = 16_384, 2048
SEED = 11


class Index:
    """Sorted projections of the rows of ``x`` (made equally long by ``longest``)."""

    def __init__(self, x: np.ndarray, longest: float, hashes: int, seed: int):
        lines = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, hashes))
        self.lines, self.scale = lines[:-1], longest
        more = np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0.0))
        values = (x @ self.lines + more[:, None] * lines[-1]).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, 1)

    def candidates(self, queries: np.ndarray, want: int):
        """For each query, the rows that collide often enough; ``want`` or
        more of them, if there are."""
        hashes, n = self.order.shape
        need = int(np.ceil(NEED * hashes))
        at = (queries @ self.lines).T
        edges = []

        def window(level: int):
            while len(edges) <= level:
                half = START * self.scale * WIDER ** len(edges)
                lo = np.stack([np.searchsorted(v, a - half, "left") for v, a in zip(self.values, at)], 1)
                hi = np.stack([np.searchsorted(v, a + half, "right") for v, a in zip(self.values, at)], 1)
                edges.append((lo, hi))
            return edges[level]

        for i in range(len(queries)):
            count = np.zeros(n, np.int64)
            level = 0
            lo, hi = (e[i] for e in window(0))
            parts = [self.order[j, lo[j] : hi[j]] for j in range(hashes)]
            while True:
                count += np.bincount(np.concatenate(parts), minlength=n)
                found = np.flatnonzero(count >= need)
                if len(found) >= min(want, n):
                    break
                level += 1
                new_lo, new_hi = (e[i] for e in window(level))
                parts = [self.order[j, new_lo[j] : lo[j]] for j in range(hashes)]
                parts += [self.order[j, hi[j] : new_hi[j]] for j in range(hashes)]
                lo, hi = new_lo, new_hi
            yield found


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    table = prepared(vectors, F.transform("embedding", lambda x: x.cast("double")), every)
    table = keep(table.where(F.exists("v", lambda x: x != 0)), "ann-vectors")
    width, unit = table.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x / F.lit(unit), F.lit(2)))
    longest = table.agg(F.sqrt(F.max(square))).first()[0]

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(x):
            qv, xv = matrix(q["v"], width, float), matrix(x["v"], width, float)
            ids, own = x["vec_id"].to_numpy(), dict(zip(x["rid"], range(len(x))))
            index = Index(xv / unit, longest, HASHES, SEED)
            want = LEAST + int(SHARE * len(x))
            for i, found in enumerate(index.candidates(qv / unit, want)):
                rid = q["rid"].iat[i]
                found = found[found != own.get(rid, -1)]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = xv[found] @ qv[i]
                scores = np.where(np.isnan(scores), -np.inf, scores)
                best = best_of(ids[found], scores, top)
                rows += [(rid, q["vec_id"].iat[i], x["vec_id"].iat[p], s) for p, s in zip(found[best], scores[best].tolist())]
        return pd.DataFrame(rows, columns=["qrid", "query_id", "vec_id", "score"])

    return meet(table, [], search, top, "double", block, queries)


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
