"""Registered queries: name -> (Spark callable, DuckDB oracle SQL or None).

Every query reads the given tables (or tables Spark derives from them) in
full. Search queries share one index per (application, data folder),
written once to the shared folder and read back by every query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import oracle as O
from quire import schema as S
from quire.operators import index as IX
from quire.operators import search as SE
from quire.operators import thesaurus as TH
from quire.operators.match import matched_docs
from quire.functions.text import tokens
from quire.plans import query as QP
from quire.sources.tables import papers, paper_view

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Ctx:
    spark: SparkSession
    sf_dir: str
    papers: DataFrame
    index: IX.Index


_CTX: dict[tuple[str, str], Ctx] = {}


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CTX:
        p = store_papers(papers(spark, sf_dir))
        _CTX[key] = Ctx(spark, sf_dir, p, IX.build_and_save(p))
    return _CTX[key]


def store_papers(p: DataFrame) -> DataFrame:
    """The paper table as stored: written once to the shared folder, range
    partitioned and sorted by DOI, so DOI lookups skip row groups."""
    from quire.session import STORED, lean, new_table_path, partitions_of

    spark = p.sparkSession
    path = new_table_path(spark, "papers")
    n = partitions_of(p, "title", "abstract")
    with lean(spark):
        p.repartitionByRange(n, "doi").sortWithinPartitions("doi").write.options(**STORED).parquet(path)
    return spark.read.parquet(path)


def lookup(spark, sf_dir):
    """Synonyms from the stored thesaurus."""
    return TH.lookup_fn(stored_entries(spark, sf_dir))


QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _scored(df: DataFrame) -> DataFrame:
    return df.select("doi", F.col("dl").cast("long").alias("dl"), "date", "category", F.round("score", 6).alias("score"))


def _scored_sql(tree) -> str:
    return f"SELECT doi, dl, date, category, round(score, 6) AS score FROM ({O.match_sql(tree)})"


def register_match(name: str, query: str, expand: bool = False):
    @register(name, None if expand else _scored_sql(QP.build(query)))
    def _q(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = QP.build(query, lookup(spark, sf_dir) if expand else QP.no_thesaurus)
        return _scored(matched_docs(ctx(spark, sf_dir).index, tree))

    return _q


# -- text and index -----------------------------------------------------------------

TOKENIZE_SQL = f"""
SELECT doi, i - 1 AS field, len(f[i]) AS n_tokens, array_to_string(f[i], ' ') AS tokens
FROM ({O.TOKENS}) t, range(1, {len(S.INDEX_FIELDS) + 1}) r(i)
"""


@register("tokenize", TOKENIZE_SQL)
def q_tokenize(spark, sf_dir):
    tok = IX.field_tokens(papers(spark, sf_dir))
    per = tok.select("doi", F.posexplode("toks").alias("field", "t"))
    return per.select(
        "doi", F.col("field").cast("long").alias("field"), F.size("t").cast("long").alias("n_tokens"),
        F.array_join("t", " ").alias("tokens"),
    )


POSTINGS_SQL = f"""
SELECT tok AS token, doi, fi - 1 AS field, pos - 1 AS pos
FROM (SELECT doi, fi, unnest(f[fi]) AS tok, unnest(range(1, len(f[fi]) + 1)) AS pos
      FROM ({O.TOKENS}) t, range(1, {len(S.INDEX_FIELDS) + 1}) r(fi))
"""


@register("build_postings", POSTINGS_SQL)
def q_build_postings(spark, sf_dir):
    p = ctx(spark, sf_dir).index.postings
    return p.select("token", "doi", F.col("field").cast("long").alias("field"), F.col("pos").cast("long").alias("pos"))


@register(
    "term_stats",
    f"SELECT token, count(DISTINCT doi) AS df, count(*) AS cf FROM ({POSTINGS_SQL}) GROUP BY token",
)
def q_term_stats(spark, sf_dir):
    return ctx(spark, sf_dir).index.terms.select("token", "df", F.col("cf").cast("long").alias("cf"))


@register("doc_lengths", f"SELECT doi, {O.DL} AS dl FROM ({O.TOKENS})")
def q_doc_lengths(spark, sf_dir):
    return ctx(spark, sf_dir).index.docs.select("doi", F.col("dl").cast("long").alias("dl"))


# -- match operators ---------------------------------------------------------------

register_match("match_term", "esat")
register_match("match_phrase", '"of the"')
register_match("match_hyphen", "of-the")
register_match("match_prefix", "esat*")
register_match("match_and", "esat AND ndon")
register_match("match_or", "esat OR ndon")
register_match("match_not", "esat NOT ndon")
register_match("match_implicit_and", "ndat ntea estion")
register_match("match_near", 'NEAR("esat" ndon, 40)')
register_match("match_field", 'abstract: "esat" OR title: ndon')
register_match("match_initial", '^"the"')
SYNONYMS_QUERY = "esat of"
register_match("match_synonyms", SYNONYMS_QUERY, expand=True)
register_match("bm25_scores", 'esat "of the" ndon* OR estion')

FLAGSHIP_QUERY = "esat ndon of the"


@register("search_relevance")
def q_search_relevance(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return SE.search(c.index, c.papers, FLAGSHIP_QUERY, limit=10, lookup=lookup(spark, sf_dir))


@register("search_date")
def q_search_date(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return SE.search(c.index, c.papers, "estion", limit=25, sort="date", lookup=lookup(spark, sf_dir))


@register("search_detail")
def q_search_detail(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return SE.search(c.index, c.papers, "ntea", limit=20, detail=True, lookup=lookup(spark, sf_dir))


@register("search_compact")
def q_search_compact(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return SE.search(c.index, c.papers, "ndat", limit=20, category=["src1", "src2", "SRC3 "], after="2024-02-01", lookup=lookup(spark, sf_dir))


@register("search_count")
def q_search_count(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return SE.search_count(c.index, c.papers, "of the", category="src4", before="2024-10-31", lookup=lookup(spark, sf_dir))


# -- filters, projections, lookups ---------------------------------------------------

_FILTER_COLS = ("doi", "title", "date", "category", "server")


def stored(spark, sf_dir) -> DataFrame:
    """The stored paper table (same rows as the paper view, sorted by DOI), so
    date / category / DOI predicates reach the parquet scan."""
    return ctx(spark, sf_dir).papers


def _filtered(spark, sf_dir, **kw) -> DataFrame:
    return stored(spark, sf_dir).where(SE.filter_column(**kw)).select(*_FILTER_COLS)


def _filtered_sql(**kw) -> str:
    return f"SELECT {', '.join(_FILTER_COLS)} FROM ({O.PAPERS}) WHERE {O.filter_sql(**kw)}"


def register_filter(name: str, **kw):
    @register(name, _filtered_sql(**kw))
    def _q(spark, sf_dir, _kw=kw):
        return _filtered(spark, sf_dir, **_kw)


register_filter("filter_category", category=" SRC7")
register_filter("filter_category_in", category=["src1", "SRC2 ", " src3"])
register_filter("filter_after", after="2024-06-01")
register_filter("filter_before", before="2024-03-15")
register_filter("filter_all", category=["src4", "src5", "src6"], after="2024-02-10", before="2024-11-30")


@register(
    "browse",
    f"SELECT doi, title, {O.COMPACT_AUTHORS} AS authors, date, category, server FROM ({O.PAPERS}) "
    f"WHERE {O.filter_sql(category='src5', after='2024-03-01')} ORDER BY date DESC, doi LIMIT 30",
)
def q_browse(spark, sf_dir):
    return SE.browse(stored(spark, sf_dir), 30, category="src5", after="2024-03-01")


# Bulk point lookup: the DOIs of the labelled documents (some have no paper
# when the label table covers ids outside the corpus).
_LABEL_DOIS_SQL = "SELECT DISTINCT '10.1101/' || lpad(doc_id::varchar, 7, '0') AS doi FROM labels"


@register(
    "get_paper",
    f"SELECT {', '.join(S.PAPER_FIELDS)} FROM ({O.PAPERS}) WHERE doi IN ({_LABEL_DOIS_SQL})",
)
def q_get_paper(spark, sf_dir):
    from quire.sources.tables import read_table

    dois = read_table(spark, sf_dir, "labels").select(
        F.concat(F.lit("10.1101/"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("doi")
    )
    return SE.get_papers(stored(spark, sf_dir), dois)


@register("compact_authors", f"SELECT doi, authors AS authors_full, {O.COMPACT_AUTHORS} AS authors FROM ({O.PAPERS})")
def q_compact_authors(spark, sf_dir):
    from quire.functions.normalize import compact_authors

    p = papers(spark, sf_dir)
    return p.select("doi", F.col("authors").alias("authors_full"), compact_authors(F.col("authors")).alias("authors"))


@register("norm_category", f"SELECT doi, category AS raw, lower(trim(category)) AS category FROM ({O.PAPER_VIEW})")
def q_norm_category(spark, sf_dir):
    from quire.functions.normalize import norm_category

    p = paper_view(spark, sf_dir)
    return p.select("doi", F.col("category").alias("raw"), norm_category(F.col("category")).alias("category"))


# DOI strings to check: every paper DOI, the same with a too-short registrant
# code, and every page URL.
_DOI_CANDIDATES_SQL = f"""
SELECT doi AS s FROM ({O.PAPER_VIEW})
UNION ALL SELECT replace(doi, '10.1101/', '10.11/') FROM ({O.PAPER_VIEW})
UNION ALL SELECT url FROM pages
"""


@register(
    "valid_doi",
    f"SELECT s, coalesce(regexp_full_match(s, '{S.DOI_PATTERN[1:-1]}'), false) AS valid FROM ({_DOI_CANDIDATES_SQL})",
)
def q_valid_doi(spark, sf_dir):
    from quire.functions.normalize import valid_doi
    from quire.sources.tables import read_table

    pv = paper_view(spark, sf_dir)
    cands = (
        pv.select(F.col("doi").alias("s"))
        .unionByName(pv.select(F.replace("doi", F.lit("10.1101/"), F.lit("10.11/")).alias("s")))
        .unionByName(read_table(spark, sf_dir, "pages").select(F.col("url").alias("s")))
    )
    return cands.select("s", valid_doi(F.col("s")).alias("valid"))


# Date strings to check: paper dates, the same with an impossible day, and
# event days written without zero padding.
_DATE_CANDIDATES_SQL = f"""
SELECT date AS s FROM ({O.PAPER_VIEW})
UNION ALL SELECT substr(date, 1, 8) || '3' || substr(date, 10, 1) FROM ({O.PAPER_VIEW})
UNION ALL SELECT strftime(ts, '%Y-%-m-%-d') FROM events
"""

from quire.functions.normalize import DATE_TEXT as _DATE_RE  # noqa: E402


@register(
    "valid_date",
    f"SELECT s, coalesce(regexp_full_match(s, '{_DATE_RE[1:-1]}') "
    f"AND try_strptime(replace(s, ' ', ''), '%Y-%m-%d') IS NOT NULL, false) AS valid FROM ({_DATE_CANDIDATES_SQL})",
)
def q_valid_date(spark, sf_dir):
    from quire.functions.normalize import valid_iso_date
    from quire.sources.tables import read_table

    pv = paper_view(spark, sf_dir)
    ev = read_table(spark, sf_dir, "events")
    cands = (
        pv.select(F.col("date").alias("s"))
        .unionByName(pv.select(F.concat(F.substring("date", 1, 8), F.lit("3"), F.substring("date", 10, 1)).alias("s")))
        .unionByName(ev.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-M-d").alias("s")))
    )
    return cands.select("s", valid_iso_date(F.col("s")).alias("valid"))


# -- aggregates -------------------------------------------------------------------------


@register(
    "category_counts",
    f"SELECT lower(trim(category)) AS category, count(*) AS count FROM ({O.PAPERS}) GROUP BY 1",
)
def q_category_counts(spark, sf_dir):
    from quire.operators.aggregates import category_counts

    return category_counts(stored(spark, sf_dir))


@register("paper_count", f"SELECT count(*) AS paper_count FROM ({O.PAPERS})")
def q_paper_count(spark, sf_dir):
    from quire.operators.aggregates import paper_count

    return paper_count(stored(spark, sf_dir))


# -- upsert, index maintenance, sync --------------------------------------------------

from quire.operators import upsert as U  # noqa: E402
from quire.operators.order import positions  # noqa: E402
from quire.plans import sync as SY  # noqa: E402
from quire.session import last_stays, materialize, new_table_path  # noqa: E402
from quire.sources.store import Store  # noqa: E402

# Sync runs over the paper view use this as "today".
TODAY = "2024-12-31"

_BATCH_SQL = f"SELECT * REPLACE ('10.1101/' || lpad((arrival // 2)::varchar, 7, '0') AS doi) FROM ({O.PAPER_VIEW})"
_VERSION_SQL = "coalesce(TRY_CAST(trim(version) AS INTEGER), 0)"
_FIELDS_SQL = ", ".join("lower(trim(category)) AS category" if c == "category" else c for c in S.PAPER_FIELDS)
_DEDUP_SQL = f"""
SELECT {_FIELDS_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY doi ORDER BY {_VERSION_SQL} DESC, arrival ASC) AS rn FROM ({_BATCH_SQL})
) WHERE rn = 1
"""


def colliding_batch(spark, sf_dir) -> DataFrame:
    """The paper view re-keyed so that documents 2k and 2k+1 share a DOI."""
    pv = paper_view(spark, sf_dir)
    return pv.withColumn(
        "doi", F.concat(F.lit("10.1101/"), F.lpad((F.col("arrival") / 2).cast("long").cast("string"), 7, "0"))
    )


@register("dedup_latest", _DEDUP_SQL)
def q_dedup_latest(spark, sf_dir):
    return U.dedup_latest(colliding_batch(spark, sf_dir))


_MERGED_SQL = f"""
SELECT {', '.join(S.PAPER_FIELDS)} FROM ({O.PAPERS}) WHERE doi NOT IN (SELECT doi FROM ({_DEDUP_SQL}))
UNION ALL SELECT {', '.join(S.PAPER_FIELDS)} FROM ({_DEDUP_SQL})
"""


@register("upsert_merge", f"SELECT doi, title, version, date, category FROM ({_MERGED_SQL})")
def q_upsert_merge(spark, sf_dir):
    merged = U.upsert(papers(spark, sf_dir), colliding_batch(spark, sf_dir))
    return merged.select("doi", "title", "version", "date", "category")


@register(
    "index_upsert",
    f"SELECT tok AS token, doi, fi - 1 AS field, pos - 1 AS pos FROM ("
    f"SELECT doi, fi, unnest(f[fi]) AS tok, unnest(range(1, len(f[fi]) + 1)) AS pos FROM ("
    f"SELECT doi, [{', '.join(O.tok(f) for f in S.INDEX_FIELDS)}] AS f FROM ({_MERGED_SQL})) t, "
    f"range(1, {len(S.INDEX_FIELDS) + 1}) r(fi))",
)
def q_index_upsert(spark, sf_dir):
    c = ctx(spark, sf_dir)
    incoming = U.dedup_latest(colliding_batch(spark, sf_dir))
    post = U.index_upsert(c.index.postings, incoming, c.index.docs)
    return post.select("token", "doi", F.col("field").cast("long").alias("field"), F.col("pos").cast("long").alias("pos"))


_TOXIC_DOIS_SQL = "SELECT '10.1101/' || lpad(doc_id::varchar, 7, '0') AS doi FROM labels WHERE toxic = 1"


@register(
    "index_delete",
    f"SELECT token, doi, field, pos FROM ({POSTINGS_SQL}) WHERE doi NOT IN ({_TOXIC_DOIS_SQL})",
)
def q_index_delete(spark, sf_dir):
    from quire.sources.tables import read_table

    c = ctx(spark, sf_dir)
    toxic = read_table(spark, sf_dir, "labels").where("toxic = 1").select(
        F.concat(F.lit("10.1101/"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("doi")
    )
    post = U.index_delete(c.index.postings, toxic, c.index.docs)
    return post.select("token", "doi", F.col("field").cast("long").alias("field"), F.col("pos").cast("long").alias("pos"))


def api_records(df: DataFrame, today: str, cursor: str | None = None) -> DataFrame:
    """Records as the catalogue delivers them: window, page cursor and index
    in page, pages of 100 ordered by arrival inside (server, window)."""
    recs = df.withColumn("w", SY.window_of(F.col("date"), today, cursor)).where(F.col("w").isNotNull())
    recs = positions(recs, ["server", "w"], ["arrival", "doi"], "p")
    return recs.withColumn("cursor", (F.floor(F.col("p") / S.PAGE_SIZE) * S.PAGE_SIZE).cast("int")).withColumn(
        "idx", (F.col("p") % S.PAGE_SIZE).cast("int")
    ).drop("p")


_W_SQL = f"floor(date_diff('day', DATE '{S.SYNC_EPOCH}', TRY_CAST(date AS DATE)) / {S.WINDOW_DAYS})::INTEGER"
_WINDOW_COUNTS_SQL = f"""
SELECT strftime(DATE '{S.SYNC_EPOCH}' + ({S.WINDOW_DAYS} * w)::INTEGER, '%Y-%m-%d') AS window_start,
       strftime(least(DATE '{S.SYNC_EPOCH}' + ({S.WINDOW_DAYS} * w + {S.WINDOW_DAYS - 1})::INTEGER, DATE '{TODAY}'), '%Y-%m-%d') AS window_end,
       server, count(DISTINCT doi) AS count
FROM (SELECT {_W_SQL} AS w, server, doi FROM ({O.PAPER_VIEW})
      WHERE TRY_CAST(date AS DATE) BETWEEN DATE '{S.SYNC_EPOCH}' AND DATE '{TODAY}')
GROUP BY w, server
"""


@register("window_counts", _WINDOW_COUNTS_SQL)
def q_window_counts(spark, sf_dir):
    recs = api_records(paper_view(spark, sf_dir), TODAY)
    _, _, counts = SY.bulk_sync(papers(spark, sf_dir).limit(0), recs, U.empty_state(spark), TODAY)
    plan = SY.window_plan(spark, TODAY)
    return counts.join(plan, "w").select("window_start", "window_end", "server", "count")


RESUME_CURSOR = "2024-03-31"


@register(
    "bulk_sync_result",
    f"SELECT count(DISTINCT doi) AS paper_count, '{TODAY}' AS last_sync_date, NULL::VARCHAR AS bulk_sync_cursor "
    f"FROM ({O.PAPER_VIEW}) WHERE date >= '2024-04-01' AND date <= '{TODAY}'",
)
def q_bulk_sync_result(spark, sf_dir):
    """Resumed bulk run into a store: the cursor says everything up to
    RESUME_CURSOR is in."""
    store = Store(spark, new_table_path(spark, "bulk-store"))
    store.publish(None, state={S.STATE_BULK_CURSOR: RESUME_CURSOR})
    with last_stays(spark):
        recs = materialize(api_records(paper_view(spark, sf_dir), TODAY, RESUME_CURSOR), "bulk-records")
    SY.run_bulk(store, lambda start, end: recs.where(F.col("date").between(start, end)), TODAY)
    state = store.state()
    return store.papers().agg(
        F.count(F.lit(1)).alias("paper_count"),
        F.lit(state.get(S.STATE_LAST_SYNC)).cast("string").alias("last_sync_date"),
        F.lit(state.get(S.STATE_BULK_CURSOR)).cast("string").alias("bulk_sync_cursor"),
    )


LAST_SYNC = "2024-10-01"
_DELTA_SQL = f"""
WITH b AS (SELECT * FROM ({_BATCH_SQL}) WHERE date >= '{LAST_SYNC}' AND date <= '{TODAY}'),
pick AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY
      CASE server WHEN 'biorxiv' THEN 1 WHEN 'medrxiv' THEN 2 ELSE 3 END DESC,
      {_VERSION_SQL} DESC, arrival ASC) AS rn FROM b) WHERE rn = 1
)
SELECT doi, title, version, date, category FROM ({O.PAPERS}) WHERE doi NOT IN (SELECT doi FROM pick)
UNION ALL SELECT doi, title, version, date, lower(trim(category)) FROM pick
"""


@register("delta_upsert", _DELTA_SQL)
def q_delta_upsert(spark, sf_dir):
    """Delta run into a store that holds the paper table."""
    store = Store(spark, new_table_path(spark, "delta-store"))
    store.commit(papers(spark, sf_dir).withColumn("arrival", F.lit(0)), state={S.STATE_LAST_SYNC: LAST_SYNC})
    b = colliding_batch(spark, sf_dir).where((F.col("date") >= LAST_SYNC) & (F.col("date") <= TODAY))
    recs = positions(b.withColumn("w", F.lit(0)), ["server"], ["arrival", "doi"], "p")
    recs = recs.withColumn("cursor", (F.floor(F.col("p") / S.PAGE_SIZE) * S.PAGE_SIZE).cast("int")).withColumn(
        "idx", (F.col("p") % S.PAGE_SIZE).cast("int")
    )
    SY.run_delta(store, lambda start, end: recs, TODAY)
    return store.papers().select("doi", "title", "version", "date", "category")


# -- thesaurus, saved queries ---------------------------------------------------------

from quire.operators import batch as BA  # noqa: E402
from quire.sources.tables import read_table  # noqa: E402


def saved_queries(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _prep_sql(source: str) -> str:
    """Words and mode of the queries of ``source`` (item_id, text)."""
    return f"""
SELECT qid, mode, wpos - 1 AS wpos, word FROM (
  SELECT qid, words,
    CASE WHEN text LIKE '%"%' OR len(list_filter(words, lambda w: NOT starts_with(w, '"') AND w IN ('AND', 'OR', 'NOT'))) > 0 THEN 'operator'
         WHEN len(words) = 0 THEN 'empty'
         WHEN len(list_filter(words, lambda w: NOT starts_with(w, '"') AND upper(w) IN ('AND', 'OR', 'NOT', 'NEAR'))) > 0 THEN 'plain'
         ELSE 'keyword' END AS mode,
    unnest(words) AS word, unnest(range(1, len(words) + 1)) AS wpos
  FROM (SELECT item_id AS qid, text, flatten(list_transform(list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda r: r <> ''),
      lambda raw: CASE WHEN contains(raw, '-') AND len(regexp_extract_all(raw, '[\\p{{L}}\\p{{N}}_*]+')) > 1
                       THEN ['"' || array_to_string(regexp_extract_all(raw, '[\\p{{L}}\\p{{N}}_*]+'), ' ') || '"']
                       ELSE regexp_extract_all(raw, '[\\p{{L}}\\p{{N}}_*]+') END)) AS words
        FROM {source}))
"""


_PREP_SQL = _prep_sql("benchmark")


@register("prepare_queries", _PREP_SQL)
def q_prepare_queries(spark, sf_dir):
    return BA.prepare(saved_queries(spark, sf_dir)).select(
        "qid", "mode", F.col("wpos").cast("long").alias("wpos"), "word"
    )


_THES: dict = {}


def thesaurus(spark, sf_dir) -> DataFrame:
    """The catalogue thesaurus, normalised and written once per application."""
    from quire.session import materialize

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _THES:
        _THES[key] = materialize(TH.normalise_records(TH.catalogue_thesaurus(spark, sf_dir)), "thesaurus")
    return _THES[key]


_ENTRIES: dict = {}


def stored_entries(spark, sf_dir) -> DataFrame:
    """The same by term, for lookups."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _ENTRIES:
        _ENTRIES[key] = TH.store_entries(thesaurus(spark, sf_dir), new_table_path(spark, "entries"))
    return _ENTRIES[key]


@register("batch_search")
def q_batch_search(spark, sf_dir):
    """Top 10 per saved query, thesaurus expansion on."""
    c = ctx(spark, sf_dir)
    return BA.batch_search(c.index, saved_queries(spark, sf_dir), thesaurus(spark, sf_dir), k=10)


@register("zero_hit_queries")
def q_zero_hit_queries(spark, sf_dir):
    c = ctx(spark, sf_dir)
    qs = saved_queries(spark, sf_dir)
    hits = BA.batch_search(c.index, qs, thesaurus(spark, sf_dir), k=10)
    return BA.zero_hits(qs, hits, c.papers)


# Thesaurus SQL: seed groups plus the sentences of conversations.
_SEED_SQL = " UNION ALL ".join(f"SELECT 'seed:{r}' AS record_id, {O.q(t)} AS term" for r, t in TH.SEED_GROUPS)
_RECORDS_SQL = f"""
SELECT DISTINCT record_id, lower(term) AS term FROM (
  {_SEED_SQL}
  UNION ALL
  SELECT 'conv:' || conv_id::varchar AS record_id, lower(trim(t)) AS term
  FROM (SELECT conv_id, unnest(regexp_split_to_array(text, '[.\n]')) AS t FROM conversations)
  WHERE len({O.tok("lower(trim(t))")}) >= 1
) WHERE term IS NOT NULL AND term <> ''
"""
_TERM_RECORDS_SQL = f"""
SELECT r.term, r.record_id, s.record_size FROM ({_RECORDS_SQL}) r
JOIN (SELECT record_id, count(*) AS record_size FROM ({_RECORDS_SQL}) GROUP BY record_id HAVING count(*) >= 2) s USING (record_id)
"""


@register("synonym_map", _TERM_RECORDS_SQL)
def q_synonym_map(spark, sf_dir):
    return TH.term_records(thesaurus(spark, sf_dir))


@register(
    "expand_terms",
    f"""
SELECT term, syn, rank FROM (
  SELECT term, syn, row_number() OVER (PARTITION BY term ORDER BY length(syn), syn) AS rank FROM (
    SELECT DISTINCT a.term, b.term AS syn FROM ({_TERM_RECORDS_SQL}) a JOIN ({_RECORDS_SQL}) b USING (record_id)
    WHERE a.term <> b.term AND length(b.term) BETWEEN {S.SYN_MIN_LEN} AND {S.SYN_MAX_LEN}))
WHERE rank <= {S.EXPAND_DEFAULT}
""",
)
def q_expand_terms(spark, sf_dir):
    return TH.expand(thesaurus(spark, sf_dir), None, S.EXPAND_DEFAULT).select(
        "term", "syn", F.col("rank").cast("long").alias("rank")
    )


@register(
    "is_term",
    f"""
SELECT t.token AS term, t.df, (k.term IS NOT NULL) AS is_term
FROM (SELECT token, count(DISTINCT doi) AS df FROM ({POSTINGS_SQL}) GROUP BY token) t
LEFT JOIN (SELECT DISTINCT term FROM ({_TERM_RECORDS_SQL})) k ON lower(t.token) = k.term
""",
)
def q_is_term(spark, sf_dir):
    """Which indexed tokens are thesaurus terms."""
    terms = ctx(spark, sf_dir).index.terms.select(F.col("token").alias("term"), "df")
    return TH.is_term(thesaurus(spark, sf_dir), terms, "term")


_KNOWN_SQL = f"SELECT DISTINCT term FROM ({_TERM_RECORDS_SQL})"
_QWORDS_SQL = """
SELECT item_id AS id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_*]+')) AS w,
       unnest(range(0, len(regexp_extract_all(text, '[\\p{L}\\p{N}_*]+')))) AS i
FROM benchmark
"""
_GROUP_SQL = f"""
WITH RECURSIVE words AS ({_QWORDS_SQL}),
known AS ({_KNOWN_SQL}),
marks AS (
  SELECT w0.id, w0.i,
         CASE WHEN w2.w IS NOT NULL AND lower(w0.w || ' ' || w1.w || ' ' || w2.w) IN (SELECT term FROM known) THEN 3
              WHEN w1.w IS NOT NULL AND lower(w0.w || ' ' || w1.w) IN (SELECT term FROM known) THEN 2
              ELSE 1 END AS m
  FROM words w0
  LEFT JOIN words w1 ON w1.id = w0.id AND w1.i = w0.i + 1
  LEFT JOIN words w2 ON w2.id = w0.id AND w2.i = w0.i + 2
),
walk(id, start) AS (
  SELECT id, 0 FROM words WHERE i = 0
  UNION ALL
  SELECT k.id, k.i + k.m FROM walk w JOIN marks k ON k.id = w.id AND k.i = w.start
  WHERE EXISTS (SELECT 1 FROM words x WHERE x.id = k.id AND x.i = k.i + k.m)
)
SELECT w.id, w.start, k.m AS n_words,
       (SELECT string_agg(x.w, ' ' ORDER BY x.i) FROM words x WHERE x.id = w.id AND x.i >= w.start AND x.i < w.start + k.m) AS phrase
FROM walk w JOIN marks k ON k.id = w.id AND k.i = w.start
"""


@register("group_phrases", _GROUP_SQL)
def q_group_phrases(spark, sf_dir):
    """Greedy thesaurus phrase grouping of every saved query's words
    (also checked against the driver-side rule in the tests)."""
    qs = saved_queries(spark, sf_dir)
    return TH.group_phrases(thesaurus(spark, sf_dir), qs, "qid", TH.query_words(F.col("text")))


_ANNOTATE_SQL = f"""
WITH k AS (
  SELECT term, tt, len(tt) AS n, least(len(tt), {S.MAX_PHRASE_WORDS}) AS m, array_to_string(tt[1:{S.MAX_PHRASE_WORDS}], ' ') AS head
  FROM (SELECT term, {O.tok('term')} AS tt FROM ({_KNOWN_SQL})) WHERE len(tt) >= 1
), d AS (
  SELECT doi, f[fi] AS t FROM ({O.TOKENS}) x, range(1, {len(S.INDEX_FIELDS) + 1}) r(fi)
), g AS (
  SELECT doi, t, i, unnest(range(1, {S.MAX_PHRASE_WORDS + 1})) AS m FROM (SELECT doi, t, unnest(range(1, len(t) + 1)) AS i FROM d)
)
SELECT g.doi, k.term, count(*) AS hits
FROM g JOIN k ON k.m = g.m AND k.head = array_to_string(g.t[g.i : g.i + g.m - 1], ' ')
WHERE g.t[g.i : g.i + k.n - 1] = k.tt
GROUP BY g.doi, k.term
"""


@register("annotate_docs", _ANNOTATE_SQL)
def q_annotate_docs(spark, sf_dir):
    """Thesaurus terms of any length found in every paper, with counts."""
    return TH.annotate_docs(thesaurus(spark, sf_dir), toks=ctx(spark, sf_dir).index.tokens)


@register("xml_terms", _RECORDS_SQL)
def q_xml_terms(spark, sf_dir):
    """The thesaurus written as descriptor XML and read back with the XML
    reader (record id, term)."""
    from quire.sources.thesaurus_xml import read_descriptor_xml, write_descriptor_xml
    from quire.session import new_table_path

    path = new_table_path(spark, "thesaurus-xml")
    write_descriptor_xml(thesaurus(spark, sf_dir), path)
    return TH.normalise_records(read_descriptor_xml(spark, path))


# -- access log -------------------------------------------------------------------------

from quire.operators import access as AC  # noqa: E402

_PATH_SQL = (
    "CASE event_type WHEN 'view' THEN '/api/search' WHEN 'click' THEN '/api/paper' WHEN 'purchase' THEN '/api/pdf' "
    "WHEN 'signup' THEN '/api/status' ELSE '/health' END"
)
_AUTH_SQL = (
    "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'Bearer wrong' || user_id::VARCHAR "
    "WHEN event_id % 17 = 0 THEN 'Basic dXNlcg==' WHEN event_id % 19 = 0 THEN 'bearer   tok' || user_id::VARCHAR || ' ' "
    "ELSE 'Bearer tok' || user_id::VARCHAR END"
)
_KEYS_SQL = """
SELECT sha256('tok' || user_id::VARCHAR) AS hash, 'user-' || user_id::VARCHAR AS label,
       (user_id % 10 = 0) AS unlimited, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS created_at
FROM events GROUP BY user_id HAVING user_id % 7 <> 0
"""
_RK_SQL = f"""
SELECT r.event_id, r.ts, r.path, r.auth, k.label, k.unlimited, substr(k.hash, 1, 8) AS key_id,
       CASE WHEN r.path IN ('/', '/health') THEN 200
            WHEN NOT starts_with(lower(r.auth), 'bearer ') THEN 401
            WHEN k.label IS NULL THEN 403 END AS pre
FROM (SELECT event_id, ts, {_PATH_SQL} AS path, {_AUTH_SQL} AS auth FROM events) r
LEFT JOIN ({_KEYS_SQL}) k
  ON k.hash = CASE WHEN starts_with(lower(r.auth), 'bearer ') THEN sha256(trim(substr(r.auth, 8))) END
"""


def requests_log(spark, sf_dir) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", F.expr(_PATH_SQL).alias("path"), F.expr(_AUTH_SQL.replace("::VARCHAR", "")).alias("authorization"))


def api_keys(spark, sf_dir) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    users = ev.groupBy("user_id").agg(F.min("ts").alias("first"))
    return users.where(F.col("user_id") % 7 != 0).select(
        F.sha2(F.concat(F.lit("tok"), F.col("user_id").cast("string")), 256).alias("hash"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("label"),
        (F.col("user_id") % 10 == 0).alias("unlimited"),
        F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


@register(
    "auth_outcome",
    f"SELECT event_id, CASE WHEN label IS NOT NULL THEN key_id END AS key_id, coalesce(pre, 200) AS status FROM ({_RK_SQL})",
)
def q_auth_outcome(spark, sf_dir):
    return AC.outcomes(requests_log(spark, sf_dir), api_keys(spark, sf_dir)).select(
        "event_id", "key_id", F.col("status").cast("int").alias("status")
    )


BURST_WINDOW, BURST_LEAST = "1 day", 2


@register(
    "request_bursts",
    f"""
SELECT key_id, unlimited, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, sum(n)::BIGINT AS requests,
       first(path ORDER BY n DESC, path) AS busiest_path
FROM (SELECT key_id, unlimited, date_trunc('day', ts) AS w, path, count(*) AS n FROM ({_RK_SQL}) WHERE label IS NOT NULL GROUP BY ALL)
GROUP BY key_id, unlimited, w HAVING sum(n) >= {BURST_LEAST}
""",
)
def q_request_bursts(spark, sf_dir):
    """Days on which a known key sent several requests."""
    return AC.request_bursts(requests_log(spark, sf_dir), api_keys(spark, sf_dir), BURST_WINDOW, BURST_LEAST)


@register(
    "key_prefix_lookup",
    f"""
SELECT p.prefix, count(k.label) AS matches, CASE WHEN count(k.label) = 1 THEN min(k.label) END AS label,
       CASE WHEN count(k.label) = 0 THEN 'unknown' WHEN count(k.label) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state
FROM (SELECT DISTINCT prefix FROM (
        SELECT substr(sha256(trim(substr(auth, 8))), 1, 8) AS prefix FROM ({_RK_SQL}) WHERE starts_with(lower(auth), 'bearer ')
        UNION ALL SELECT substr(sha256(trim(substr(auth, 8))), 1, 1) FROM ({_RK_SQL}) WHERE starts_with(lower(auth), 'bearer '))) p
LEFT JOIN ({_KEYS_SQL}) k ON starts_with(k.hash, p.prefix)
GROUP BY p.prefix
""",
)
def q_key_prefix_lookup(spark, sf_dir):
    """Logged key ids (8 characters) and one-character prefixes, resolved
    against the key table."""
    req = requests_log(spark, sf_dir)
    h = AC.hash_token(AC.bearer_token(F.col("authorization")))
    tagged = req.where(AC.bearer_token(F.col("authorization")).isNotNull()).select(h.alias("h"))
    prefixes = tagged.select(F.substring("h", 1, 8).alias("prefix")).unionByName(tagged.select(F.substring("h", 1, 1).alias("prefix")))
    return AC.prefix_lookup(prefixes, api_keys(spark, sf_dir))


_RAW_SQL = """
SELECT event_id,
  CASE event_type WHEN 'view' THEN floor(value * 1000)::BIGINT::VARCHAR WHEN 'click' THEN '' WHEN 'error' THEN 'ten'
       WHEN 'signup' THEN '-' || user_id::VARCHAR ELSE user_id::VARCHAR END AS limit_raw,
  CASE event_type WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'click' THEN strftime(ts, '%Y-%-m-%-d')
       WHEN 'error' THEN 'nope' ELSE '' END AS after_raw,
  CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m') || '-32' ELSE '' END AS before_raw,
  ['1', 'true', 'YES', 'no'][user_id % 4 + 1] AS detail_raw,
  CASE WHEN user_id % 2 = 0 THEN ' src' || (user_id % 20)::VARCHAR || ', ,SRC' || ((user_id + 1) % 20)::VARCHAR || ' '
       ELSE 'src' || (user_id % 20)::VARCHAR END AS category_raw,
  CASE event_type WHEN 'click' THEN '10.1101/' || lpad(user_id::VARCHAR, 7, '0') WHEN 'purchase' THEN 'not-a-doi' END AS doi_raw
FROM events
"""

_VALID_DATE_SQL = (
    "(coalesce(regexp_full_match({c}, '" + _DATE_RE[1:-1] + "') AND try_strptime(replace({c}, ' ', ''), '%Y-%m-%d') IS NOT NULL, false))"
)


def _dchk(c: str) -> str:
    return f"({c} IS NULL OR {c} = '' OR {_VALID_DATE_SQL.replace('{c}', c)})"


_CATS = "list_filter(list_transform(string_split(coalesce(category_raw, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_LIM_OK = "(limit_raw IS NULL OR limit_raw = '' OR regexp_full_match(trim(limit_raw), '[+-]?\\d+'))"


@register(
    "request_log_typed",
    f"""
SELECT event_id,
  CASE WHEN limit_raw IS NULL OR limit_raw = '' THEN {S.DEFAULT_LIMIT}
       WHEN {_LIM_OK} THEN greatest(1, least(trim(limit_raw)::HUGEINT, {S.MAX_LIMIT}))::INTEGER END AS "limit",
  CASE WHEN {_dchk('after_raw')} AND after_raw <> '' THEN after_raw END AS after,
  CASE WHEN {_dchk('before_raw')} AND before_raw <> '' THEN before_raw END AS before,
  coalesce(lower(detail_raw) IN ('1', 'true', 'yes'), false) AS detail,
  CASE WHEN len({_CATS}) = 0 THEN NULL ELSE array_to_string({_CATS}, ',') END AS category,
  len({_CATS}) > 1 AS category_is_list,
  CASE WHEN NOT {_LIM_OK} THEN 'bad_limit:' || limit_raw
       WHEN NOT {_dchk('after_raw')} THEN 'bad_after:' || after_raw
       WHEN NOT {_dchk('before_raw')} THEN 'bad_before:' || before_raw END AS reject,
  CASE WHEN doi_raw IS NOT NULL AND NOT coalesce(regexp_full_match(doi_raw, '{S.DOI_PATTERN[1:-1]}'), false)
       THEN 'bad_doi:' || doi_raw END AS doi_reject
FROM ({_RAW_SQL})
""",
)
def q_request_log_typed(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    raw = ev.select(
        "event_id",
        F.expr(
            "CASE event_type WHEN 'view' THEN cast(cast(floor(value * 1000) AS bigint) AS string) WHEN 'click' THEN '' "
            "WHEN 'error' THEN 'ten' WHEN 'signup' THEN concat('-', cast(user_id AS string)) ELSE cast(user_id AS string) END"
        ).alias("limit_raw"),
        F.when(F.col("event_type") == "view", F.date_format(t, "yyyy-MM-dd"))
        .when(F.col("event_type") == "click", F.date_format(t, "yyyy-M-d"))
        .when(F.col("event_type") == "error", F.lit("nope"))
        .otherwise(F.lit(""))
        .alias("after_raw"),
        F.when(F.col("event_type") == "purchase", F.concat(F.date_format(t, "yyyy-MM"), F.lit("-32"))).otherwise(F.lit("")).alias("before_raw"),
        F.element_at(F.array(*[F.lit(x) for x in ("1", "true", "YES", "no")]), (F.col("user_id") % 4 + 1).cast("int")).alias("detail_raw"),
        F.when(
            F.col("user_id") % 2 == 0,
            F.concat(F.lit(" src"), (F.col("user_id") % 20).cast("string"), F.lit(", ,SRC"), ((F.col("user_id") + 1) % 20).cast("string"), F.lit(" ")),
        ).otherwise(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))).alias("category_raw"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("10.1101/"), F.lpad(F.col("user_id").cast("string"), 7, "0")))
        .when(F.col("event_type") == "purchase", F.lit("not-a-doi"))
        .alias("doi_raw"),
    )
    return AC.typed_requests(raw)


# -- sources and sinks ------------------------------------------------------------------

from quire.functions.normalize import pdf_url as _pdf_url  # noqa: E402
from quire.session import new_table_path  # noqa: E402
from quire.sources import api_pages as AP  # noqa: E402
from quire.sources import pdf as PD  # noqa: E402


def api_page_folder(spark, sf_dir) -> str:
    """Land the paper view as catalogue API pages (once per application and
    data folder)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _PAGES:
        recs = api_records(paper_view(spark, sf_dir), TODAY).join(SY.window_plan(spark, TODAY), "w")
        _PAGES[key] = new_table_path(spark, "api-pages")
        AP.land_records(recs, _PAGES[key])
    return _PAGES[key]


_PAGES: dict = {}

_POS_SQL = f"""
SELECT *, row_number() OVER (PARTITION BY server, {_W_SQL} ORDER BY arrival, doi) - 1 AS p
FROM ({O.PAPER_VIEW}) WHERE TRY_CAST(date AS DATE) BETWEEN DATE '{S.SYNC_EPOCH}' AND DATE '{TODAY}'
"""


@register(
    "src_pages",
    f"SELECT server, strftime(DATE '{S.SYNC_EPOCH}' + ({S.WINDOW_DAYS} * {_W_SQL})::INTEGER, '%Y-%m-%d') AS window_start, "
    f"(p // {S.PAGE_SIZE} * {S.PAGE_SIZE})::INTEGER AS cursor, (p % {S.PAGE_SIZE})::INTEGER AS idx, doi FROM ({_POS_SQL})",
)
def q_src_pages(spark, sf_dir):
    return AP.read_records(spark, api_page_folder(spark, sf_dir)).select("server", "window_start", "cursor", "idx", "doi")


@register("normalize_paper", f"SELECT {', '.join(S.PAPER_FIELDS)} FROM ({O.PAPER_VIEW})")
def q_normalize_paper(spark, sf_dir):
    return AP.read_records(spark, api_page_folder(spark, sf_dir)).select(*S.PAPER_FIELDS)


@register("union_servers", f"SELECT server, count(*) AS papers FROM ({O.PAPER_VIEW}) GROUP BY server")
def q_union_servers(spark, sf_dir):
    """Both collections in one table, by server."""
    return AP.read_records(spark, api_page_folder(spark, sf_dir)).groupBy("server").agg(F.count(F.lit(1)).alias("papers"))


_BY_DOI_SQL = f"SELECT * REPLACE ('10.1102/' || lpad((arrival // 4)::varchar, 7, '0') AS doi) FROM ({O.PAPER_VIEW})"
_LAST_VERSION_SQL = f"""
SELECT doi, server, title, version, arrival FROM (
  SELECT *, row_number() OVER (PARTITION BY doi ORDER BY CASE server WHEN 'biorxiv' THEN 1 WHEN 'medrxiv' THEN 2 ELSE 3 END) AS srv_rank
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi, server ORDER BY arrival DESC) AS rn FROM ({_BY_DOI_SQL})) WHERE rn = 1)
) WHERE srv_rank = 1
"""


def by_doi_source(spark, sf_dir) -> DataFrame:
    """A second catalogue answering by DOI: every DOI has a version list per
    server (four documents per DOI)."""
    pv = paper_view(spark, sf_dir)
    return pv.withColumn(
        "doi", F.concat(F.lit("10.1102/"), F.lpad((F.col("arrival") / 4).cast("long").cast("string"), 7, "0"))
    )


def fetch_last_version(source: DataFrame) -> DataFrame:
    """Per DOI: the last element of the first server's list that has one."""
    last = source.groupBy("doi", "server").agg(F.max_by(F.struct(*S.PAPER_FIELDS, "arrival"), F.col("arrival")).alias("r"))
    pick = last.groupBy("doi").agg(F.min_by(F.col("r"), SY.server_rank(F.col("server"))).alias("r"))
    return pick.select("doi", F.col("r.server").alias("server"), F.col("r.title").alias("title"), F.col("r.version").alias("version"), F.col("r.arrival").alias("arrival"))


@register("fetch_last_version", _LAST_VERSION_SQL)
def q_fetch_last_version(spark, sf_dir):
    return fetch_last_version(by_doi_source(spark, sf_dir))


_REQ_DOIS_SQL = f"""
SELECT DISTINCT doi FROM (
  SELECT '10.1101/' || lpad(doc_id::varchar, 7, '0') AS doi FROM labels
  UNION ALL SELECT '10.1102/' || lpad((doc_id // 4)::varchar, 7, '0') FROM labels
  UNION ALL SELECT '10.1103/' || lpad(doc_id::varchar, 7, '0') FROM labels)
"""


@register(
    "resolve_doi",
    f"""
SELECT r.doi, coalesce(p.title, f.title) AS title, coalesce(p.server, f.server) AS server,
       CASE WHEN p.doi IS NULL THEN 'api' END AS _source
FROM ({_REQ_DOIS_SQL}) r
LEFT JOIN ({O.PAPERS}) p USING (doi)
LEFT JOIN ({_LAST_VERSION_SQL}) f ON f.doi = r.doi
WHERE p.doi IS NOT NULL OR f.doi IS NOT NULL
""",
)
def q_resolve_doi(spark, sf_dir):
    """Local lookup first; DOIs not stored come from the by-DOI catalogue,
    tagged as such; unknown DOIs give no row."""
    labels = read_table(spark, sf_dir, "labels")
    pad = lambda c: F.lpad(c.cast("long").cast("string"), 7, "0")
    req = (
        labels.select(F.concat(F.lit("10.1101/"), pad(F.col("doc_id"))).alias("doi"))
        .unionByName(labels.select(F.concat(F.lit("10.1102/"), pad(F.col("doc_id") / 4)).alias("doi")))
        .unionByName(labels.select(F.concat(F.lit("10.1103/"), pad(F.col("doc_id"))).alias("doi")))
        .distinct()
    )
    local = papers(spark, sf_dir).join(req, "doi", "left_semi").select("doi", "title", "server", F.lit(None).cast("string").alias("_source"))
    fallback = (
        fetch_last_version(by_doi_source(spark, sf_dir))
        .join(req, "doi", "left_semi")
        .join(local.select("doi"), "doi", "left_anti")
        .select("doi", "title", "server", F.lit("api").alias("_source"))
    )
    return local.unionByName(fallback)


@register(
    "pdf_url",
    f"SELECT doi, 'https://www.' || coalesce(nullif(server, ''), '{S.DEFAULT_SERVER}') || '.org/content/' || doi || 'v' "
    f"|| coalesce(nullif(version, ''), '1') || '.full.pdf' AS url FROM ({O.PAPERS})",
)
def q_pdf_url(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("doi", _pdf_url(F.col("doi"), F.col("server"), F.col("version")).alias("url"))


_PDF_BODY_SQL = (
    "CASE version WHEN '1' THEN '%PDF-1.4' || chr(10) || abstract WHEN '2' THEN '<html>' || title ELSE '' END"
)


@register(
    "pdf_check",
    f"""
SELECT replace(doi, '/', '_') AS file, strlen({_PDF_BODY_SQL}) AS bytes,
       round(strlen({_PDF_BODY_SQL}) / 1048576.0, 2) AS size_mb,
       CASE WHEN strlen({_PDF_BODY_SQL}) > {S.MAX_PDF_BYTES} THEN 413
            WHEN NOT starts_with({_PDF_BODY_SQL}, '%PDF') THEN 502 ELSE 200 END AS status,
       CASE WHEN strlen({_PDF_BODY_SQL}) > {S.MAX_PDF_BYTES} THEN 'too_large'
            WHEN NOT starts_with({_PDF_BODY_SQL}, '%PDF') THEN 'not_pdf' END AS reason
FROM ({O.PAPERS})
""",
)
def q_pdf_check(spark, sf_dir):
    """Write one file per paper (good PDF, wrong content, empty), then check
    them all with the binary-file reader."""
    p = papers(spark, sf_dir)
    body = (
        F.when(F.col("version") == "1", F.concat(F.lit("%PDF-1.4\n"), F.col("abstract")))
        .when(F.col("version") == "2", F.concat(F.lit("<html>"), F.col("title")))
        .otherwise(F.lit(""))
    )
    folder = new_table_path(spark, "pdfs")
    manifest_path = new_table_path(spark, "pdf-manifest")
    PD.write_pdfs(p.select("doi", body.cast("binary").alias("content")), folder).write.parquet(manifest_path)
    return PD.check_pdfs(spark, folder, spark.read.parquet(manifest_path))


@register(
    "status_row",
    f"SELECT count(*) AS paper_count, '{TODAY}' AS last_sync, NULL::VARCHAR AS bulk_sync_cursor, "
    f"round(sum({' + '.join(f'coalesce(strlen({c}), 0)' for c in S.PAPER_FIELDS)}) / 1048576.0, 2) AS db_size_mb "
    f"FROM ({O.PAPERS})",
)
def q_status_row(spark, sf_dir):
    from quire.operators.aggregates import status_row

    state = U.state_set(U.empty_state(spark), S.STATE_LAST_SYNC, TODAY)
    return status_row(papers(spark, sf_dir), state)


# Oracle for batch_search: the same rules over the whole corpus, with
# list/postings SQL (no candidate driving), so it checks the distributed plan.
_PIECES = "list_filter(list_transform(regexp_extract_all(term, '[^*]+\\*?'), lambda p: {'toks': " + O.tok("p") + ", 'prefix': ends_with(p, '*')}), lambda x: len(x.toks) > 0)"
def _scored_ctes(source: str) -> str:
    """CTEs up to scored(qid, doi, score) for the queries of ``source`` (item_id, text)."""
    return f"""
WITH RECURSIVE prep AS ({_prep_sql(source)}),
kw AS (
  SELECT qid, wpos, word, row_number() OVER (PARTITION BY qid ORDER BY wpos) - 1 AS i
  FROM prep WHERE mode = 'keyword' AND word IS NOT NULL AND NOT starts_with(word, '"')
),
known AS ({_KNOWN_SQL}),
marks AS (
  SELECT w0.qid, w0.i, w0.wpos,
         CASE WHEN w2.word IS NOT NULL AND lower(w0.word || ' ' || w1.word || ' ' || w2.word) IN (SELECT term FROM known) THEN 3
              WHEN w1.word IS NOT NULL AND lower(w0.word || ' ' || w1.word) IN (SELECT term FROM known) THEN 2
              ELSE 1 END AS m
  FROM kw w0
  LEFT JOIN kw w1 ON w1.qid = w0.qid AND w1.i = w0.i + 1
  LEFT JOIN kw w2 ON w2.qid = w0.qid AND w2.i = w0.i + 2
),
walk(qid, start) AS (
  SELECT DISTINCT qid, 0 FROM kw
  UNION ALL
  SELECT k.qid, k.i + k.m FROM walk w JOIN marks k ON k.qid = w.qid AND k.i = w.start
  WHERE EXISTS (SELECT 1 FROM kw x WHERE x.qid = k.qid AND x.i = k.i + k.m)
),
kgroups AS (
  SELECT w.qid, k.wpos AS clause, k.m AS n_words,
         (SELECT string_agg(x.word, ' ' ORDER BY x.i) FROM kw x WHERE x.qid = w.qid AND x.i >= w.start AND x.i < w.start + k.m) AS term
  FROM walk w JOIN marks k ON k.qid = w.qid AND k.i = w.start
),
groups AS (
  SELECT qid, clause, n_words, term FROM kgroups
  UNION ALL
  SELECT qid, wpos AS clause, 1 AS n_words, word AS term FROM prep
  WHERE mode = 'plain' AND word IS NOT NULL AND NOT starts_with(word, '"')
),
alts AS (
  SELECT qid, clause, 0 AS alt,
         CASE WHEN n_words > 1 THEN [{{'toks': {O.tok('term')}, 'prefix': false}}] ELSE {_PIECES} END AS parts
  FROM groups
  UNION ALL
  SELECT qid, wpos AS clause, 0 AS alt, [{{'toks': {O.tok('word')}, 'prefix': false}}] AS parts FROM prep
  WHERE mode IN ('keyword', 'plain') AND starts_with(word, '"')
  UNION ALL
  SELECT g.qid, g.clause, e.rank AS alt, [{{'toks': {O.tok('e.syn')}, 'prefix': false}}] AS parts
  FROM kgroups g JOIN (
    SELECT term, syn, rank FROM (
      SELECT term, syn, row_number() OVER (PARTITION BY term ORDER BY length(syn), syn) AS rank FROM (
        SELECT DISTINCT a.term, b.term AS syn FROM ({_TERM_RECORDS_SQL}) a JOIN ({_RECORDS_SQL}) b USING (record_id)
        WHERE a.term <> b.term AND length(b.term) BETWEEN {S.SYN_MIN_LEN} AND {S.SYN_MAX_LEN}))
    WHERE rank <= {S.SEARCH_SYNONYMS}) e ON e.term = lower(g.term)
),
cl AS (
  SELECT qid, clause, alt, part, ph.toks AS toks, ph.prefix AS prefix,
         array_to_string(ph.toks, ' ') || CASE WHEN ph.prefix THEN '*' ELSE '' END AS key
  FROM (SELECT qid, clause, alt, unnest(parts) AS ph, unnest(range(0, len(parts))) AS part FROM alts)
  WHERE len(ph.toks) > 0
),
kp AS (
  SELECT key, k, prefix, unnest(toks) AS term, unnest(range(0, k)) AS j
  FROM (SELECT DISTINCT key, toks, prefix, len(toks) AS k FROM cl)
),
occ AS (
  SELECT p.doi, kp.key
  FROM ({POSTINGS_SQL}) p JOIN kp
    ON (p.token = kp.term AND NOT (kp.prefix AND kp.j = kp.k - 1))
    OR (kp.prefix AND kp.j = kp.k - 1 AND starts_with(p.token, kp.term))
  WHERE p.pos - kp.j >= 0
  GROUP BY p.doi, p.field, p.pos - kp.j, kp.key, kp.k
  HAVING count(*) = kp.k
),
tf AS (SELECT doi, key, count(*) AS tf FROM occ GROUP BY doi, key),
df AS (SELECT key, count(DISTINCT doi)::DOUBLE AS df FROM occ GROUP BY key),
slot AS (SELECT cl.qid, tf.doi, cl.clause, cl.alt, cl.part, cl.key, tf.tf FROM cl JOIN tf USING (key)),
pa AS (SELECT qid, clause, alt, count(DISTINCT part) AS parts_all FROM cl GROUP BY qid, clause, alt),
sat AS (
  SELECT DISTINCT s.qid, s.doi, s.clause FROM (
    SELECT qid, doi, clause, alt, count(DISTINCT part) AS ph FROM slot GROUP BY qid, doi, clause, alt) s
  JOIN pa USING (qid, clause, alt) WHERE s.ph = pa.parts_all
),
nc AS (SELECT qid, count(DISTINCT clause) AS c_all FROM cl GROUP BY qid),
matched AS (
  SELECT s.qid, s.doi FROM (SELECT qid, doi, count(*) AS c FROM sat GROUP BY qid, doi) s
  JOIN nc USING (qid) WHERE s.c = nc.c_all
),
dls AS (SELECT doi, {O.DL} AS dl FROM ({O.TOKENS})),
st AS (SELECT count(*)::DOUBLE AS n_docs, sum(dl)::DOUBLE / count(*) AS avgdl FROM dls),
contrib AS (
  SELECT slot.qid, slot.doi, slot.clause, slot.alt, slot.part,
         (CASE WHEN ln((st.n_docs - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) <= 0.0 THEN {S.IDF_FLOOR}::DOUBLE
               ELSE ln((st.n_docs - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) END)
         * ((slot.tf::DOUBLE * {S.BM25_K1 + 1.0}::DOUBLE)
            / (slot.tf::DOUBLE + {S.BM25_K1}::DOUBLE * ({1.0 - S.BM25_B}::DOUBLE + {S.BM25_B}::DOUBLE * dls.dl / st.avgdl))) AS c
  FROM slot JOIN matched USING (qid, doi) JOIN df USING (key) JOIN dls USING (doi), st
),
scored AS (
  SELECT qid, doi, list_reduce(list(c ORDER BY clause, alt, part), lambda a, b: a + b) AS score
  FROM contrib GROUP BY qid, doi
)
"""


_TOP_SQL = """
SELECT qid, rank, doi, round(score, 6) AS score FROM (
  SELECT qid, doi, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doi) AS rank FROM scored
) WHERE rank <= 10
"""
_BATCH_SQL = _scored_ctes("benchmark") + _TOP_SQL
ORACLE["batch_search"] = _BATCH_SQL
ORACLE["zero_hit_queries"] = f"""
WITH hits AS ({_BATCH_SQL}), n AS (SELECT count(*) AS n FROM ({O.PAPERS}))
SELECT item_id AS qid, n.n AS searched,
       CASE WHEN n.n = 0 THEN 'empty_corpus'
            WHEN item_id IN (SELECT qid FROM ({_PREP_SQL}) WHERE mode = 'empty') THEN 'no_words' ELSE 'no_match' END AS reason
FROM benchmark, n WHERE item_id NOT IN (SELECT qid FROM hits)
"""


# Oracles of the single searches: the same CTEs for one query.
def _one(query: str) -> str:
    return _scored_ctes(f"(SELECT 1 AS item_id, {O.q(query)} AS text)")


def _found_sql(query: str, limit: int, sort: str = "relevance", detail: bool = False, **filters) -> str:
    order = "s.score DESC, s.doi" if sort == "relevance" else "p.date DESC, p.doi"
    cols = [f"{O.COMPACT_AUTHORS} AS authors" if c == "authors" and not detail else c for c in (S.PAPER_FIELDS if detail else S.COMPACT_FIELDS)]
    return _one(query) + f"""
SELECT {', '.join(cols)} FROM (
  SELECT p.* FROM ({O.PAPERS}) p JOIN scored s USING (doi) WHERE {O.filter_sql(**filters, prefix='p.')} ORDER BY {order} LIMIT {limit})
"""


ORACLE["match_synonyms"] = _one(SYNONYMS_QUERY) + f"""
SELECT doi, dl, date, category, round(score, 6) AS score FROM scored JOIN dls USING (doi) JOIN (SELECT doi, date, category FROM ({O.PAPERS})) USING (doi)
"""
ORACLE["search_relevance"] = _found_sql(FLAGSHIP_QUERY, 10)
ORACLE["search_date"] = _found_sql("estion", 25, sort="date")
ORACLE["search_detail"] = _found_sql("ntea", 20, detail=True)
ORACLE["search_compact"] = _found_sql("ndat", 20, category=["src1", "src2", "SRC3 "], after="2024-02-01")
ORACLE["search_count"] = _one("of the") + f"""
SELECT count(*) AS count FROM scored JOIN (SELECT doi, date, category FROM ({O.PAPERS})) USING (doi)
WHERE {O.filter_sql(category='src4', before='2024-10-31')}
"""


# -- saved queries in operator syntax ---------------------------------------------------

# Queries made of the first words of each benchmark text (at least seven).
_OP_TEXT_SQL = f"""
SELECT item_id AS qid, item_id % 4 AS form, t FROM (SELECT item_id, {O.tok('text')} AS t FROM benchmark) WHERE len(t) >= 7
"""


def operator_queries(spark, sf_dir) -> DataFrame:
    """(qid, text): saved queries with phrases, OR, NOT, prefixes and fields, in
    four forms by item."""
    items = saved_queries(spark, sf_dir).select("qid", tokens(F.col("text")).alias("t")).where("size(t) >= 7")
    form = F.col("qid") % 4
    text = (
        F.when(form == 0, F.format_string('"%s %s" OR %s', *[F.col("t")[i] for i in (0, 1, 4)]))
        .when(form == 1, F.format_string('"%s" AND "%s" NOT "%s"', *[F.col("t")[i] for i in (0, 3, 2)]))
        .when(form == 2, F.format_string('"%s %s" NOT ("%s" OR "%s")', *[F.col("t")[i] for i in (1, 2, 0, 6)]))
        .otherwise(F.format_string('title: "%s" OR abstract: ("%s %s" AND %s*)', *[F.col("t")[i] for i in (0, 1, 2, 3)]))
    )
    return items.select("qid", text.alias("text"))


@register(
    "batch_operators",
    f"""
WITH items AS ({_OP_TEXT_SQL}),
sl AS (
  SELECT qid, unnest(CASE form
    WHEN 0 THEN [{{'slot': 0, 'toks': t[1:2], 'prefix': false, 'field': -1}}, {{'slot': 1, 'toks': t[5:5], 'prefix': false, 'field': -1}}]
    WHEN 1 THEN [{{'slot': 0, 'toks': t[1:1], 'prefix': false, 'field': -1}}, {{'slot': 1, 'toks': t[4:4], 'prefix': false, 'field': -1}},
                 {{'slot': 2, 'toks': t[3:3], 'prefix': false, 'field': -1}}]
    WHEN 2 THEN [{{'slot': 0, 'toks': t[2:3], 'prefix': false, 'field': -1}}, {{'slot': 1, 'toks': t[1:1], 'prefix': false, 'field': -1}},
                 {{'slot': 2, 'toks': t[7:7], 'prefix': false, 'field': -1}}]
    ELSE [{{'slot': 0, 'toks': t[1:1], 'prefix': false, 'field': 0}}, {{'slot': 1, 'toks': t[2:3], 'prefix': false, 'field': 1}},
          {{'slot': 2, 'toks': t[4:4], 'prefix': true, 'field': 1}}] END, recursive := true)
  FROM items
),
kp AS (SELECT qid, slot, len(toks) AS k, prefix, field AS want, unnest(toks) AS term, unnest(range(0, len(toks))) AS j FROM sl),
occ AS (
  SELECT kp.qid, kp.slot, p.doi FROM ({POSTINGS_SQL}) p JOIN kp
    ON CASE WHEN kp.prefix THEN starts_with(p.token, kp.term) ELSE p.token = kp.term END AND (kp.want = -1 OR p.field = kp.want)
  GROUP BY kp.qid, kp.slot, kp.k, p.doi, p.field, p.pos - kp.j HAVING count(*) = kp.k
),
tf AS (SELECT qid, slot, doi, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT qid, slot, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
per AS (
  SELECT qid, doi, coalesce(bool_or(slot = 0), false) AS s0, coalesce(bool_or(slot = 1), false) AS s1, coalesce(bool_or(slot = 2), false) AS s2
  FROM tf GROUP BY qid, doi
),
matched AS (
  SELECT qid, doi FROM per JOIN items USING (qid)
  WHERE CASE form WHEN 0 THEN s0 OR s1 WHEN 1 THEN s0 AND s1 AND NOT s2 WHEN 2 THEN s0 AND NOT s1 AND NOT s2 ELSE s0 OR (s1 AND s2) END
),
dls AS (SELECT doi, {O.DL} AS dl FROM ({O.TOKENS})),
st AS (SELECT count(*)::DOUBLE AS n_docs, sum(dl)::DOUBLE / count(*) AS avgdl FROM dls),
scored AS (
  SELECT qid, doi, sum(CASE WHEN n_docs - df <= df THEN {S.IDF_FLOOR}::DOUBLE ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
    * tf * {S.BM25_K1 + 1.0} / (tf + {S.BM25_K1} * ({1.0 - S.BM25_B} + {S.BM25_B} * dl / avgdl)) ORDER BY slot) AS score
  FROM tf JOIN matched USING (qid, doi) JOIN df USING (qid, slot) JOIN dls USING (doi), st GROUP BY qid, doi
)
"""
    + _TOP_SQL,
)
def q_batch_operators(spark, sf_dir):
    """Top 10 per saved query in operator syntax."""
    return BA.batch_search(ctx(spark, sf_dir).index, operator_queries(spark, sf_dir), None, k=10)
