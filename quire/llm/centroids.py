"""Centroid clustering over dictionaries of subvectors.

Vectors are kept in chunks of up to ``CHUNK`` rows. In a chunk, every block of
``WIDTH`` dimensions is dictionary-encoded without loss: its distinct subvectors
and, per vector, which of them it has. A round computes the exact squared
distance of every distinct subvector to the centroids' part of that block once,
and a vector's distances are the sums of these partial distances by its codes.
Sums of a cluster are formed by code as well: how often each subvector occurs in
the cluster, times the subvector. Vectors are never shuffled; a round moves one
row per chunk and cluster.

Components are integers, floor(256 x) of x as double, and so are centroids and
distances: nothing depends on the order of summation.

Defined results: vectors that are null, have another number of components than
``DIMS``, or hold a null or non-finite one take no part and have no row;
components beyond +-2**27 stay there, so distances fit 64 bits (an inertia beyond
stays at the largest); a null id counts as ``null`` in the draw of the first
centroids, and rows with equal ids are drawn in the order of their components;
with fewer vectors than ``clusters``, each is a first centroid; repeated rows
are clustered each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batches_of, saved, table
from quire.llm.vectors import usable

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SEED = 2
WIDTH = 2
CHUNK = 8192
AT_ONCE = 4  # chunks in one Arrow batch
LIMIT = 2**27
MOST = 2**63 - 1


def components(vector: Column) -> Column:
    grid = lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(float(-LIMIT))), F.lit(float(LIMIT))))
    return F.transform(vector, lambda x: grid(x).cast("int"))


def encoded(grid: np.ndarray, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries of the blocks of ``grid``, and codes (blocks x rows)."""
    books, codes = [], []
    for lo in range(0, grid.shape[1], width):
        part = np.ascontiguousarray(grid[:, lo : lo + width].astype(np.int32))
        one = part.view([("", np.int32)] * part.shape[1]).ravel()
        _, first, code = np.unique(one, return_index=True, return_inverse=True)
        books.append(part[first])
        codes.append(code.ravel())
    return books, np.array(codes, np.int64).reshape(len(books), len(grid))


def distances(books: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids), by sums of partial ones."""
    out = np.zeros((codes.shape[1], len(centroids)), np.int64)
    lo = 0
    for book, code in zip(books, codes):
        part = np.zeros((len(book), len(centroids)), np.int64)
        for j in range(book.shape[1]):
            part += (book[:, j, None].astype(np.int64) - centroids[None, :, lo + j]) ** 2
        out += part[code]
        lo += book.shape[1]
    return out


def cluster_sums(books: list[np.ndarray], codes: np.ndarray, nearest: np.ndarray, clusters: int) -> np.ndarray:
    """Per cluster its number of vectors and the sum of each component."""
    out = [np.bincount(nearest, minlength=clusters).astype(np.int64)[:, None]]
    for book, code in zip(books, codes):
        times = np.bincount(nearest * len(book) + code, minlength=clusters * len(book)).reshape(clusters, len(book))
        out.append(times.astype(np.int64) @ book.astype(np.int64))
    return np.concatenate(out, axis=1)


def chunks(rows: DataFrame) -> DataFrame:
    """(ids, books, codes) of ``rows`` (vec_id, v), a row per chunk."""

    def one(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
        b = pd.concat(parts)
        head, rest = b[:CHUNK], b[CHUNK:]
        books, codes = encoded(np.stack(head["v"].to_numpy()))
        ids = [None if pd.isna(i) else int(i) for i in head["vec_id"]]
        code = codes.astype(np.uint16).tobytes()  # a chunk has at most 2**16 rows
        return pd.DataFrame({"ids": [ids], "books": [[x.tobytes() for x in books]], "codes": [code]}), [rest] if len(rest) else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= CHUNK:
                out, held = one(held)
                yield out
        if sum(map(len, held)):
            yield one(held)[0]

    own = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v")  # ids stay whole numbers where some are null
    return saved(own.mapInPandas(run, "ids array<long>, books array<binary>, codes binary"), "centroid-chunks", CHUNK)


def opened(row) -> tuple[list[np.ndarray], np.ndarray]:
    books = [np.frombuffer(x, np.int32).reshape(-1, WIDTH if DIMS % WIDTH == 0 or k + 1 < len(row.books) else DIMS % WIDTH) for k, x in enumerate(row.books)]
    return books, np.frombuffer(row.codes, np.uint16).reshape(len(books), -1).astype(np.int64)


def moved(coded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors."""
    names = ["n", *(f"s{j}" for j in range(DIMS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                books, codes = opened(row)
                nearest = distances(books, codes, centroids).argmin(1)  # the first of equal ones
                sums = pd.DataFrame(cluster_sums(books, codes, nearest, len(centroids)), columns=names)
                yield sums.assign(cluster=np.arange(len(sums), dtype=np.int32))[sums["n"] > 0]

    found = coded.mapInPandas(run, ", ".join(f"{c} long" for c in names) + ", cluster int")
    out = centroids.copy()
    with batches_of(coded.sparkSession, AT_ONCE):
        sums = found.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names)).collect()  # a row per cluster
    for r in sums:
        out[r["cluster"]] = [r[c] // r["n"] for c in names[1:]]
    return out


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256."""
    kept = vectors.where(usable(F.col("embedding")) & (F.size("embedding") == DIMS))
    kept = kept.select(F.col("vec_id"), components(F.col("embedding")).alias("v"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    centroids = np.array([r["v"] for r in kept.orderBy(draw, "v").limit(clusters).collect()], np.int64).reshape(-1, DIMS)
    coded = chunks(kept)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(coded, centroids)
    final = centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                far = distances(*opened(row), final)
                nearest = far.argmin(1)
                yield pd.DataFrame({"vec_id": pd.array(list(row.ids), "Int64"), "cluster": nearest.astype(np.int32), "distance": far[np.arange(len(far)), nearest]})

    out = saved(coded.mapInPandas(run, "vec_id long, cluster int, distance long"), "centroid-result", AT_ONCE)
    sums = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    of = lambda f, kind: F.element_at(F.array(*[F.lit(f(k)).cast(kind) for k in range(len(final))] or [F.lit(None).cast(kind)]), F.col("cluster") + 1)
    return out.select(
        F.col("vec_id").cast(vectors.schema["vec_id"].dataType),
        "cluster",
        "distance",
        of(lambda k: min(sums.get(k, 0), MOST), "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"),
        of(lambda k: names[k], "string").alias("centroid_sha256"),
    )


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _oracle() -> str:
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT rid, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIMS + 1}) AS t(i)),
c0 AS MATERIALIZED (SELECT CAST(rid - 1 AS INTEGER) AS k, i, x AS y FROM v WHERE rid <= {CLUSTERS})"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(
            f"""d{n} AS (SELECT rid, k, sum((x - y) * (x - y)) AS d FROM v JOIN c{n} USING (i) GROUP BY rid, k),
a{n} AS MATERIALIZED (SELECT rid, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM d{n} GROUP BY rid)"""
        )
        if n < ROUNDS:
            steps.append(
                f"""m{n} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM v JOIN a{n} USING (rid) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN m.n IS NULL THEN c.y ELSE CAST((m.s - (((m.s % m.n) + m.n) % m.n)) // m.n AS BIGINT) END AS y
  FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k AND m.i = c.i)"""
            )
    return f"""WITH {", ".join(steps)},
names AS (SELECT k, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, a.k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rid) JOIN names ON names.k = a.k"""


ORACLE = _oracle()
