"""Vectors in blocks: every block of queries meets every block of candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved


NO_ID = 2**63 - 1  # stands for a null id while ids are numbers of numpy


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def prepared(vectors: DataFrame, components: Column, every: int) -> DataFrame:
    """(rid, vec_id, v, asks): usable vectors under a row id of their own, and
    whether they are queries."""
    rows = vectors.where(usable(F.col("embedding"))).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        components.alias("v"),
        F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("asks"),
    )
    return rows.withColumn("rid", F.monotonically_increasing_id())


def matrix(rows: pd.Series, width: int, kind) -> np.ndarray:
    """Arrays as rows of a matrix; shorter ones count as if followed by zeros."""
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def meet(
    table: DataFrame, extra: list[str], search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], top: int, score: str,
    block: int, queries: int,
) -> DataFrame:
    """Best ``top`` of all (query, candidate) pairs that ``search`` returns for
    blocks, as (query_id, rank, vec_id, score)."""
    n, asked = table.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-asked // queries))
    spread = lambda k: F.pmod(F.xxhash64("rid"), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cols = ["rid", "vec_id", "v", *extra]
    ask = table.where("asks").select(*cols, F.lit(True).alias("ask"), spread(q_blocks).cast("int").alias("qb"), each(c_blocks).alias("cb"))
    own = table.select(*cols, F.lit(False).alias("ask"), each(q_blocks).alias("qb"), spread(c_blocks).cast("int").alias("cb"))

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        ask = rows["ask"].to_numpy(bool)
        return search(rows[ask], rows[~ask])

    found = ask.unionByName(own).groupBy("qb", "cb").applyInPandas(both, f"qrid long, query_id long, vec_id long, score {score}")
    best = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")


def best_of(ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * top:
        least = np.partition(scores, len(scores) - top)[len(scores) - top]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:top]]


def keep(table: DataFrame, name: str) -> DataFrame:
    return saved(table, name)
