"""Catalogue summaries: category histogram, row count, status row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.normalize import category_key


def category_counts(papers: DataFrame) -> DataFrame:
    """(category, count) on the normalised category, most papers first."""
    return (
        papers.groupBy(category_key(F.col("category")).alias("category"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("category"))
    )


def paper_count(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("paper_count"))


def status_row(papers: DataFrame, state: DataFrame) -> DataFrame:
    """One row: paper count, last sync date, bulk cursor and the table's
    logical size in MB (bytes of all stored text, rounded to 2 places)."""
    size = F.sum(
        sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in S.PAPER_FIELDS), F.lit(0)).cast("long")
    )
    from quire.operators.upsert import state_value

    return papers.agg(
        F.count(F.lit(1)).alias("paper_count"),
        state_value(state, S.STATE_LAST_SYNC).alias("last_sync"),
        state_value(state, S.STATE_BULK_CURSOR).alias("bulk_sync_cursor"),
        F.round(F.coalesce(size, F.lit(0)) / F.lit(1024.0 * 1024.0), 2).alias("db_size_mb"),
    )
