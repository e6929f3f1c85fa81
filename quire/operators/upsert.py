"""Upserts on the paper table and the matching index maintenance.

Parquet has no MERGE, so an upsert is ``target left_anti batch`` union the
de-duplicated batch, written to a fresh folder (never over a path that is
being read). All steps are aggregations with map-side combine or joins on
``doi``; a DOI repeated in a third of a batch is reduced in every task
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.normalize import norm_category, version_int
from quire.operators.bits import bit_table, maybe
from quire.operators.index import build_postings
from quire.session import literal_table, materialize

FEW = 50_000  # removed DOIs that are broadcast


def _pick(rows: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """One row per doi: the one with the greatest ``key`` (max_by aggregates
    partially, so a hot DOI never gathers its rows in one task)."""
    best = F.max_by(F.struct(*[F.col(c) for c in fields]), key).alias("_best")
    return rows.groupBy("doi").agg(best).select("doi", *[F.col(f"_best.{c}").alias(c) for c in fields if c != "doi"])


def dedup_latest(batch: DataFrame, order_col: str = "arrival", page_col: str | None = None) -> DataFrame:
    """Highest integer version per DOI; equal versions keep the earliest
    arrival. Of records that came in pages, the last page with a DOI wins,
    whatever its version. Category is normalised as it is written."""
    fields = [c for c in S.PAPER_FIELDS]
    page = [F.col(page_col).alias("p")] if page_col else []
    key = F.struct(*page, version_int(F.col("version")).alias("v"), (-F.col(order_col)).alias("a"))
    picked = _pick(batch, key, fields)
    return picked.select(*[norm_category(F.col(c)).alias(c) if c == "category" else F.col(c) for c in S.PAPER_FIELDS])


def merge(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """Delete-then-insert: every incoming DOI replaces the stored row, even
    when the stored version is higher."""
    kept = target.join(incoming.select("doi"), "doi", "left_anti")
    return kept.select(*S.PAPER_FIELDS).unionByName(incoming.select(*S.PAPER_FIELDS))


def upsert(target: DataFrame, batch: DataFrame, order_col: str = "arrival") -> DataFrame:
    return merge(target, dedup_latest(batch, order_col))


def upsert_count(batch: DataFrame) -> DataFrame:
    """Rows an upsert writes: distinct DOIs of the batch (0 when empty)."""
    return batch.agg(F.count_distinct("doi").alias("count"))


def index_delete(postings: DataFrame, removed: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Postings without the removed DOIs. With the ``docs`` of all postings only
    those are shuffled that can't be told without: a posting stays if no removed DOI
    has the bit of its own, goes if one has and no DOI that stays, and else (a few of
    a hundred at some millions of documents) is joined."""
    if docs is None:
        return postings.join(removed.select("doi"), "doi", "left_anti")
    gone = materialize(removed.select("doi").where("doi is not null").distinct(), "removed-dois")
    n = gone.count()
    if n <= FEW:
        return postings.join(F.broadcast(gone), "doi", "left_anti")
    stay = materialize(docs.select("doi").join(gone, "doi", "left_anti"), "kept-dois")
    own = F.xxhash64("doi")
    off, on = bit_table(gone.select(own), n, "removed-bits"), bit_table(stay.select(own), stay.count(), "kept-bits")
    clear = maybe(postings, own, off, "_off").where(F.col("doi").isNull() | ~F.col("_off")).drop("_off")
    both = maybe(maybe(postings.where("doi is not null"), own, off), own, on, "_on").where("_on")
    # a key made from the bits: else Spark puts this join before those with the bits
    asked = both.withColumn("_asked", F.when(F.col("_on"), F.col("doi")))
    listed = maybe(gone, own, on).select(F.col("doi").alias("_asked"))
    return clear.unionByName(asked.join(listed, "_asked", "left_anti").select(*clear.columns))


def index_upsert(postings: DataFrame, incoming: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Postings after replacing the incoming papers: old rows of their DOIs go,
    the new rows' tokens come in. ``docs`` are those of all postings."""
    return index_delete(postings, incoming, docs).select("token", "doi", "field", "pos").unionByName(
        build_postings(incoming).select("token", "doi", "field", "pos")
    )


def refresh_terms(terms: DataFrame, removed_postings: DataFrame, added_postings: DataFrame) -> DataFrame:
    """Term statistics after an index change, touching only the changed
    tokens: df/cf deltas from the removed and added postings."""

    def per_token(p: DataFrame, sign: int) -> DataFrame:
        per_doc = p.groupBy("token", "doi").agg(F.count(F.lit(1)).alias("tf"))
        return per_doc.groupBy("token").agg(
            (F.count(F.lit(1)) * sign).alias("d_df"), (F.sum("tf") * sign).alias("d_cf")
        )

    delta = (
        per_token(removed_postings, -1)
        .unionByName(per_token(added_postings, 1))
        .groupBy("token")
        .agg(F.sum("d_df").alias("d_df"), F.sum("d_cf").alias("d_cf"))
    )
    joined = terms.join(delta, "token", "full_outer")
    return joined.select(
        "token",
        (F.coalesce("df", F.lit(0)) + F.coalesce("d_df", F.lit(0))).cast("long").alias("df"),
        (F.coalesce("cf", F.lit(0)) + F.coalesce("d_cf", F.lit(0))).cast("long").alias("cf"),
    ).where(F.col("df") > 0)


# -- key/value state ---------------------------------------------------------------


def state_set(state: DataFrame, key: str, value: str) -> DataFrame:
    row = literal_table(state.sparkSession, [(key, value)], S.STATE_SCHEMA)
    return state.where(F.col("key") != key).unionByName(row)


def state_delete(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") != key)


def state_get(state: DataFrame, key: str) -> str | None:
    """Driver read of one state value (a one-row lookup)."""
    rows = state.where(F.col("key") == key).select("value").limit(1).collect()
    return rows[0][0] if rows else None


def empty_state(spark) -> DataFrame:
    return literal_table(spark, [], S.STATE_SCHEMA)


def state_value(state: DataFrame, key: str):
    """Column: the value stored under ``key`` (scalar subquery, null if none)."""
    return state.where(F.col("key") == key).agg(F.max("value")).scalar()
