"""Readers for the given parquet tables and the paper view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.normalize import norm_category


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The paper view over ``documents``: one paper per document, with a fixed
# date range, noisy categories, versions 1-3 and two servers. ``arrival`` is
# the arrival order used to break version ties.
_PAPER_VIEW_COLUMNS = (
    "concat('10.1101/', lpad(cast(doc_id AS string), 7, '0')) AS doi",
    "substring_index(text, '.', 1) AS title",
    "array_join(transform(sequence(0L, doc_id % 4),"
    " i -> concat('Author ', cast((doc_id * 7 + i) % 50 AS string))), '; ') AS authors",
    "text AS abstract",
    "date_format(date_add(date'2024-01-01', cast(doc_id % 365 AS int)), 'yyyy-MM-dd') AS date",
    "CASE WHEN doc_id % 3 = 0 THEN concat('  ', upper(source), ' ') ELSE source END AS category",
    "cast(doc_id % 3 + 1 AS string) AS version",
    "CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS type",
    "'' AS license",
    "'' AS published",
    "'' AS author_corresponding",
    "concat('Univ ', upper(lang)) AS author_corresponding_institution",
    "'' AS jatsxml",
    "CASE WHEN doc_id % 2 = 0 THEN 'biorxiv' ELSE 'medrxiv' END AS server",
    "doc_id AS arrival",
)


def paper_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw papers as a catalogue page would deliver them (category not normalised)."""
    return read_table(spark, sf_dir, "documents").selectExpr(*_PAPER_VIEW_COLUMNS)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored paper table: the view after the write-time category clean-up."""
    raw = paper_view(spark, sf_dir)
    return raw.select(*[norm_category(F.col(c)).alias(c) if c == "category" else F.col(c) for c in S.PAPER_FIELDS])
