"""Column-level normalisers and validators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import schema as S


def norm_category(col: Column) -> Column:
    """null -> '', surrounding whitespace removed, lower-case."""
    return F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", ""))


def category_key(col: Column) -> Column:
    """Grouping/filter key on a stored category (lower of blank-trimmed)."""
    return F.lower(F.trim(col))


def compact_authors(col: Column) -> Column:
    """Keep first and last author when there are more than two."""
    names = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != "")
    return (
        F.when(F.size(names) <= 2, F.array_join(names, "; "))
        .otherwise(F.concat(F.element_at(names, 1), F.lit("; ... ; "), F.element_at(names, -1)))
    )


def version_int(col: Column) -> Column:
    """Integer version; anything unparsable (or missing) counts as 0."""
    trimmed = F.trim(col)
    return F.coalesce(F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("int")), F.lit(0))


def valid_doi(col: Column) -> Column:
    return F.coalesce(col.rlike(S.DOI_PATTERN), F.lit(False))


# Accepted date text: four-digit year, month and day with or without zero
# padding (a day may also be padded with one blank), and a real calendar day.
DATE_TEXT = r"^\d{4}-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])$"


def valid_iso_date(col: Column) -> Column:
    """True for a real calendar date written year-month-day."""
    return F.coalesce(
        col.rlike(DATE_TEXT) & F.try_to_timestamp(F.replace(col, F.lit(" "), F.lit("")), F.lit("yyyy-M-d")).isNotNull(),
        F.lit(False),
    )


def pdf_url(doi: Column, server: Column, version: Column) -> Column:
    srv = F.coalesce(F.nullif(server, F.lit("")), F.lit(S.DEFAULT_SERVER))
    ver = F.coalesce(F.nullif(version, F.lit("")), F.lit("1"))
    return F.format_string(S.PDF_URL_FORMAT, srv, doi, ver)
