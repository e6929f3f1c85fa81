"""Search, count, browse and lookup over the paper table and its index."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.normalize import compact_authors, norm_category
from quire.operators.index import Index
from quire.operators.match import matched_docs
from quire.plans.query import SynonymLookup, build, no_thesaurus


def filter_column(
    category: str | Sequence[str] | None = None,
    after: str | None = None,
    before: str | None = None,
    category_col: str = "category",
    date_col: str = "date",
) -> Column:
    """AND of the category / date predicates; TRUE when none is given.

    Stored categories are normalised once at write (trim + lower), so the
    stored value is compared directly and the predicate reaches the scan."""
    preds: list[Column] = []
    if category:
        key = F.col(category_col)
        if isinstance(category, str):
            preds.append(key == norm_category(F.lit(category)))
        else:
            wanted = sorted({c.strip().lower() for c in category if c is not None})
            preds.append(key.isin(wanted))
    if after:
        preds.append(F.col(date_col) >= F.lit(after))
    if before:
        preds.append(F.col(date_col) <= F.lit(before))
    return functools.reduce(operator.and_, preds) if preds else F.lit(True)


def project(papers: DataFrame, detail: bool) -> DataFrame:
    """Result columns: every field (detail) or the compact six, with the
    category normalised and, in compact rows, the author list shortened."""
    fields = S.PAPER_FIELDS if detail else S.COMPACT_FIELDS
    return papers.select(*[_proj_col(c, detail) for c in fields])


def search(
    idx: Index,
    papers: DataFrame,
    query: str,
    limit: int = S.DEFAULT_LIMIT,
    category: str | Sequence[str] | None = None,
    after: str | None = None,
    before: str | None = None,
    detail: bool = False,
    sort: str = "relevance",
    lookup: SynonymLookup = no_thesaurus,
    with_score: bool = False,
) -> DataFrame:
    """Top ``limit`` papers for ``query``; relevance order only when asked for
    and there is a query, newest first otherwise (ties: doi ascending)."""
    if not query.strip():
        return browse(papers, limit, category, after, before, detail)
    tree = build(query, lookup)
    by_relevance = sort == "relevance"
    scored = by_relevance or with_score
    hits = matched_docs(idx, tree, score=scored).where(filter_column(category, after, before))
    order = [F.desc("score"), F.asc("doi")] if by_relevance else [F.desc("date"), F.asc("doi")]
    score = F.col("score") if scored else F.lit(None).cast("double").alias("score")
    top = hits.select("doi", "date", score).orderBy(*order).limit(limit).select("doi", "score")
    rows = papers.join(top, "doi")
    fields = S.PAPER_FIELDS if detail else S.COMPACT_FIELDS
    res = rows.select(*[_proj_col(c, detail) for c in fields], F.col("score").alias("_score"))
    final_order = [F.desc("_score"), F.asc("doi")] if by_relevance else [F.desc("date"), F.asc("doi")]
    res = res.orderBy(*final_order)
    return res if with_score else res.drop("_score")


def _proj_col(c: str, detail: bool) -> Column:
    if c == "category":
        return norm_category(F.col(c)).alias(c)
    if c == "authors" and not detail:
        return compact_authors(F.col(c)).alias(c)
    return F.col(c)


def search_count(
    idx: Index,
    papers: DataFrame,
    query: str,
    category: str | Sequence[str] | None = None,
    after: str | None = None,
    before: str | None = None,
    lookup: SynonymLookup = no_thesaurus,
) -> DataFrame:
    """One row, ``count``: matching papers (no ranking, no limit)."""
    if not query.strip():
        base = papers.where(filter_column(category, after, before))
    else:
        base = matched_docs(idx, build(query, lookup), score=False).where(filter_column(category, after, before))
    return base.agg(F.count(F.lit(1)).alias("count"))


def browse(
    papers: DataFrame,
    limit: int = S.DEFAULT_LIMIT,
    category: str | Sequence[str] | None = None,
    after: str | None = None,
    before: str | None = None,
    detail: bool = False,
) -> DataFrame:
    """No text query: filtered papers, newest first."""
    rows = papers.where(filter_column(category, after, before)).orderBy(F.desc("date"), F.asc("doi")).limit(limit)
    return project(rows, detail)


def get_papers(papers: DataFrame, dois: DataFrame) -> DataFrame:
    """Bulk point lookup: papers whose DOI is in ``dois(doi)`` (semi-join)."""
    return project(papers.join(dois.select("doi").distinct(), "doi", "left_semi"), detail=True)
