"""Thesaurus: descriptor records of equivalent terms, membership, expansion,
phrase grouping and corpus annotation.

A thesaurus is a DataFrame ``records(record_id, term)``. Two terms are
synonyms when they share a record. The symmetric synonym relation is never
materialised - it is quadratic in the record size - so everything works off
the factored form:

* membership: a term is known when one of its records has two or more terms;
* expansion: every record keeps only its ``n + 1`` shortest terms (a top-k
  per record, partially applied before the shuffle), and a term's synonyms
  are the shortest of its records' lists, itself excluded. Output is at most
  ``n`` rows per term, whatever the record sizes.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.text import tokens
from quire.operators.bits import bit_table, maybe
from quire.operators.index import field_tokens
from quire.session import STORED, lean, literal_table, materialize, new_table_path
from quire.sources.tables import read_table

# --- fixed values: seed descriptor groups (record id, term) ------------------------
SEED_GROUPS = (
    (1, "the"),
    (1, "that"),
    (1, "in the"),
    (2, "of"),
    (2, "from"),
    (3, "esat"),
    (3, "ndon"),
)
# ---------------------------------------------------------------------------------


def seed_records(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [(f"seed:{r}", t) for r, t in SEED_GROUPS], "record_id string, term string")


def derived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per conversation: the distinct sentences and lines of all
    its turns, lower-cased."""
    conv = read_table(spark, sf_dir, "conversations")
    sentence = F.explode(F.split("text", r"[.\n]")).alias("s")
    rows = conv.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("record_id"), sentence)
    term = F.lower(F.trim("s"))
    return rows.select("record_id", term.alias("term")).where(F.size(tokens(F.col("term"))) >= 1).distinct()


def catalogue_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_records(spark).unionByName(derived_records(spark, sf_dir))


def normalise_records(records: DataFrame) -> DataFrame:
    """Lower-case, drop blanks and duplicates within a record."""
    return (
        records.select("record_id", F.lower(F.col("term")).alias("term"))
        .where(F.col("term").isNotNull() & (F.col("term") != ""))
        .distinct()
    )


def term_records(records: DataFrame) -> DataFrame:
    """(term, record_id, record_size) for records with at least two terms:
    the factored synonym map."""
    recs = normalise_records(records)
    sizes = recs.groupBy("record_id").agg(F.count(F.lit(1)).alias("record_size")).where("record_size >= 2")
    return recs.join(sizes, "record_id").select("term", "record_id", "record_size")


def known_terms(records: DataFrame) -> DataFrame:
    """(term): every term that has at least one synonym."""
    return term_records(records).select("term").distinct()


def is_term(records: DataFrame, words: DataFrame, col: str = "term") -> DataFrame:
    """``words`` with a boolean ``is_term`` (case-insensitive exact membership)."""
    keys = known_terms(records).select(F.col("term").alias("_k"), F.lit(True).alias("_hit"))
    out = words.join(keys, F.lower(words[col]) == keys["_k"], "left")
    return out.select(*[words[c] for c in words.columns], F.coalesce(F.col("_hit"), F.lit(False)).alias("is_term"))


def _shortest_per_record(recs: DataFrame, n: int) -> DataFrame:
    eligible = recs.where(F.length("term").between(S.SYN_MIN_LEN, S.SYN_MAX_LEN))
    w = Window.partitionBy("record_id").orderBy(F.length("term"), F.col("term"))
    return eligible.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n + 1).drop("r")


def expand(records: DataFrame, terms: DataFrame | None = None, n: int = S.EXPAND_DEFAULT) -> DataFrame:
    """(term, syn, rank): up to ``n`` synonyms per term, 3..60 characters,
    shortest first, then alphabetical. ``terms(term)`` limits the terms
    expanded (default: every known term)."""
    tr = term_records(records)
    if terms is not None:
        tr = tr.join(terms.select(F.lower("term").alias("term")).distinct(), "term", "left_semi")
    short = _shortest_per_record(normalise_records(records), n).select("record_id", F.col("term").alias("syn"))
    cand = tr.join(short, "record_id").where(F.col("syn") != F.col("term")).select("term", "syn").distinct()
    w = Window.partitionBy("term").orderBy(F.length("syn"), F.col("syn"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def store_thesaurus(records: DataFrame, path: str) -> DataFrame:
    """Write the normalised records once, sorted by term, and read them back."""
    normalise_records(records).repartitionByRange("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(path)
    return records.sparkSession.read.parquet(path)


def load_thesaurus(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored thesaurus; without one a warning, and search goes on without
    expansion."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        warnings.warn(f"no thesaurus at {path}: synonyms are off", stacklevel=2)
        return None


def entries(records: DataFrame, n: int = S.EXPAND_DEFAULT) -> DataFrame:
    """(term, record_id, short): each known term with the ``n + 1`` shortest
    terms of its record, so that a lookup reads the rows of its terms and
    nothing else. A row holds at most ``n + 1`` terms of bounded length."""
    recs = normalise_records(records)
    short = _shortest_per_record(recs, n).groupBy("record_id").agg(F.collect_list("term").alias("short"))
    return term_records(records).join(short, "record_id", "left").select(
        "term", "record_id", F.coalesce("short", F.array().cast("array<string>")).alias("short")
    )


def store_entries(records: DataFrame, path: str, n: int = S.EXPAND_DEFAULT) -> DataFrame:
    """Write the entries once, sorted by term, and read them back."""
    by_term = entries(records, n).repartitionByRange("term", "record_id").sortWithinPartitions("term")
    by_term.write.mode("errorifexists").parquet(path)
    return records.sparkSession.read.parquet(path)


def lookup_fn(records: DataFrame | None, n: int = S.SEARCH_SYNONYMS):
    """Driver-side lookup for one query: candidate windows -> known terms and
    their synonyms. ``records`` is a stored table of :func:`entries`, of which a
    lookup reads the row groups of its terms (``term IN`` is pushed down), or a
    plain table of records. The result is bounded by the number of candidates
    times ``n``, at most ``EXPAND_DEFAULT``."""
    if records is None:
        return lambda candidates: {}
    if n > S.EXPAND_DEFAULT:
        raise ValueError(f"at most {S.EXPAND_DEFAULT} synonyms a term")

    def lookup(candidates: Iterable[str]) -> dict[str, list[str]]:
        cands = sorted({c.lower() for c in candidates})
        if not cands:
            return {}
        if "short" in records.columns:
            rows = records
        else:  # only the records that hold a candidate
            own = records.where(F.lower("term").isin(cands)).select("record_id").distinct()
            rows = entries(records.join(own, "record_id", "left_semi"))
        rows = rows.where(F.col("term").isin(cands)).select("term", F.explode_outer("short").alias("syn")).distinct()
        syn = F.when(F.col("syn") != F.col("term"), F.struct(F.length("syn").alias("n"), F.col("syn").alias("s")))
        # a window ends where the driver needs no more: n rows a candidate and one for itself
        w = Window.partitionBy("term").orderBy(F.length("syn"), F.col("syn"))
        few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n + 2)
        got = few.groupBy("term").agg(F.array_sort(F.collect_list(syn)).alias("s")).collect()
        return {r["term"]: [x["s"] for x in r["s"][:n]] for r in got}

    return lookup


def query_words(text):
    """Search words of a text column: runs of letters, digits, ``_``, ``*``."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_*]+)"), 1)


def group_phrases(records: DataFrame, texts: DataFrame, id_col: str, words_col) -> DataFrame:
    """Greedy longest-match grouping of every text's words into thesaurus
    phrases (3 words, then 2, left to right, no overlap).

    ``(id, start, n_words, phrase)`` - one row per group, unmatched words as
    one-word groups. Candidate windows are joined to the known terms; the left
    to right choice is a fold over the (bounded) candidate list of one text.
    """
    words = texts.select(F.col(id_col).alias("id"), F.posexplode(words_col).alias("i", "w"))
    w = Window.partitionBy("id").orderBy("i")
    win = words.select(
        "id",
        "i",
        "w",
        F.lead("w", 1).over(w).alias("w1"),
        F.lead("w", 2).over(w).alias("w2"),
    )
    cands = win.select(
        "id",
        "i",
        "w",
        F.lower(F.concat_ws(" ", "w", "w1", "w2")).alias("c3"),
        F.lower(F.concat_ws(" ", "w", "w1")).alias("c2"),
        F.col("w2").isNotNull().alias("has3"),
        F.col("w1").isNotNull().alias("has2"),
    )
    keys = known_terms(records)
    k3 = keys.select(F.col("term").alias("c3"), F.lit(3).alias("m3"))
    k2 = keys.select(F.col("term").alias("c2"), F.lit(2).alias("m2"))
    marked = (
        cands.join(k3, "c3", "left")
        .join(k2, "c2", "left")
        .select(
            "id",
            "i",
            "w",
            F.when(F.col("has3") & F.col("m3").isNotNull(), 3)
            .when(F.col("has2") & F.col("m2").isNotNull(), 2)
            .otherwise(1)
            .alias("m"),
        )
    )
    return _fold_groups(marked)


def _fold_groups(marked: DataFrame) -> DataFrame:
    """Left-to-right non-overlapping choice: a position starts a group iff it
    is not covered by an earlier chosen group. Only positions where a
    multi-word match starts are folded; the list per text is bounded by its
    length in words."""
    multi = marked.where(F.col("m") > 1)
    starts = multi.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    chosen = starts.select(
        "id",
        F.aggregate(
            "c",
            F.struct(F.lit(-1).alias("next_free"), F.array().cast("array<struct<i:int,m:int>>").alias("picked")),
            lambda acc, x: F.when(
                x["i"] >= acc["next_free"],
                F.struct(
                    (x["i"] + x["m"]).alias("next_free"),
                    F.concat(acc["picked"], F.array(x.cast("struct<i:int,m:int>"))).alias("picked"),
                ),
            ).otherwise(acc),
        )["picked"].alias("picked"),
    ).select("id", F.explode("picked").alias("g")).select("id", F.col("g.i").alias("gi"), F.col("g.m").alias("gm"))
    cover = chosen.select("id", "gi", "gm", F.explode(F.sequence(F.col("gi"), F.col("gi") + F.col("gm") - 1)).alias("i"))
    joined = marked.join(cover, ["id", "i"], "left")
    grouped = (
        joined.withColumn("start", F.coalesce("gi", "i"))
        .groupBy("id", "start")
        .agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("ws"))
    )
    return grouped.select(
        "id",
        "start",
        F.size("ws").alias("n_words"),
        F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("phrase"),
    )


SEED = 7  # of the hashes of joined windows


def _doubled(df: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """``df`` with columns ``h2``, ``h4``, ... up to ``most``: hashes of all
    windows of so many tokens, from ``h1``, the hashes of the tokens. Two windows
    of p make one of 2 p. A column a step, so that each is computed once."""
    sizes = [1]
    while 2 * sizes[-1] <= most:
        p = sizes[-1]
        prev = F.col(f"h{p}")
        n = F.greatest(F.size(prev) - p, F.lit(0))
        pairs = F.arrays_zip(F.slice(prev, F.lit(1), n).alias("a"), F.slice(prev, F.lit(p + 1), n).alias("b"))
        df = df.withColumn(f"h{2 * p}", F.transform(pairs, lambda x: F.xxhash64(x["a"], x["b"], F.lit(SEED))))
        sizes.append(2 * p)
    return df, sizes


COMMON = 1 << 18  # one-word terms that are broadcast
TURNS = 4  # in which the hits of those are counted, so that a fourth is in shuffle files at a time


def _mixed(k: Column, h: Column) -> Column:
    return F.xxhash64(h, k, F.lit(SEED))


def _term_keys(terms: DataFrame, most: int) -> DataFrame:
    """(term, k, p, first, hash) of terms (term, tt, k, p): the hash of the first window
    of p tokens, and of the whole term by its first and last one."""
    keys, sizes = _doubled(terms.withColumn("h1", F.transform("tt", lambda t: F.xxhash64(t))), most)
    windows = functools.reduce(lambda rest, p: F.when(F.col("p") == p, F.col(f"h{p}")).otherwise(rest), sizes[1:], F.col("h1"))
    keys = keys.select("term", "k", "p", windows.alias("w")).select("term", "k", "p", F.get("w", F.lit(0)).alias("first"), F.get("w", F.col("k") - F.col("p")).alias("last"))
    return keys.select("term", "k", "p", "first", F.when(F.col("k") == F.col("p"), F.col("first")).otherwise(F.xxhash64("first", "last", F.lit(SEED))).alias("hash"))


def _common_hits(keys: DataFrame, words: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The one-word terms among ``keys`` (of ``n``, at most ``COMMON``: those met most
    often), and their hits (doi, term, hits). Most hits are theirs; they are broadcast,
    so that a task counts them where it reads the ``words`` (doi, hash), documents in turns."""
    common = keys.where("k = 1").select("term", "hash")
    if n > COMMON:
        met = words.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
        common = common.join(met, "hash").orderBy(F.desc("n"), "term").limit(COMMON).select("term", "hash")
    common = materialize(common, "common-terms")
    spark, path = keys.sparkSession, new_table_path(keys.sparkSession, "common-hits")
    with lean(spark):
        for i in range(TURNS):
            own = words.where(F.pmod(F.xxhash64("doi"), F.lit(TURNS)) == i)
            hits = own.join(F.broadcast(common), "hash").groupBy("doi", "term").agg(F.count(F.lit(1)).alias("hits"))
            hits.write.mode("append").options(**STORED).parquet(path)
    return common, spark.read.parquet(path)


def annotate_docs(records: DataFrame, papers: DataFrame | None = None, toks: DataFrame | None = None) -> DataFrame:
    """(doi, term, hits): thesaurus terms of any length found in the indexed
    fields of ``papers`` (or of their stored tokens ``toks``), with counts.

    A term of k tokens is known by its first and last windows of p tokens, p being the
    largest power of two up to k, which cover it together (one window if k = p). The
    windows of 1, 2, 4, ... tokens of all fields are hashed by doubling; where one may be
    the first of a term, it is put together with the window at the other end for each k
    that terms have, and what may be a whole term then is joined to the terms by (k, hash).
    So a row is shuffled for a whole term that is met, not for each term that shares a
    window, of which common windows have ever more. "May be" is a bit in a table of
    bounded size, broadcast. Terms of one word, which make most of the hits, are broadcast
    too, up to a fixed number. Hashes have 64 bits; two different windows agree with a
    chance of 2 ** -64."""
    terms = known_terms(records).select("term", tokens(F.col("term")).alias("tt")).where(F.size("tt") >= 1)
    spark = terms.sparkSession
    terms = terms.withColumns({"k": F.size("tt"), "p": F.pow(F.lit(2), F.floor(F.log2(F.size("tt")) + 1e-9)).cast("int")})
    most = terms.agg(F.max("p")).first()[0]
    if not most:
        return literal_table(spark, [], "doi string, term string, hits long")
    keys = materialize(_term_keys(terms, most), "term-windows")
    fields = (field_tokens(papers) if toks is None else toks).select("doi", F.posexplode("toks").alias("field", "t"))
    words = fields.select("doi", F.explode("t").alias("t")).select("doi", F.xxhash64("t").alias("hash"))
    lengths = {(r.p, r.k): r.n for r in keys.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    common, hits = _common_hits(keys, words, lengths.get((1, 1), 0))
    if lengths.get((1, 1), 0) <= COMMON:
        lengths.pop((1, 1), None)
    if not lengths:
        return hits
    keys = materialize(keys.join(common.select("term"), "term", "left_anti"), "rest-terms")
    n = sum(lengths.values())
    firsts = bit_table(keys.select("first"), n, "first-bits")
    wholes = bit_table(keys.select(_mixed(F.col("k"), F.col("hash"))), n, "term-bits")

    fields = fields.where(F.size("t") > 0).select("doi", F.transform("t", lambda t: F.xxhash64(t)).alias("h1"))
    fields, sizes = _doubled(fields, most)
    sizes = [p for p in sizes if any(p == q for q, _ in lengths)]
    by_size = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"h{p}").alias("w")) for p in sizes])
    windows = fields.select("doi", F.explode(by_size).alias("x")).select("doi", "x.p", "x.w", F.posexplode("x.w").alias("pos", "first"))
    windows = maybe(windows, F.col("first"), firsts)
    ks = {p: F.array(*[F.lit(k) for q, k in sorted(lengths) if q == p]) for p in sizes}
    ks = functools.reduce(lambda rest, p: F.when(F.col("p") == p, ks[p]).otherwise(rest), sizes[1:], ks[sizes[0]])
    windows = windows.withColumn("k", F.explode(ks))
    last = F.get("w", F.col("pos") + F.col("k") - F.col("p"))
    whole = F.when(F.col("k") == F.col("p"), F.col("first")).when(last.isNotNull(), F.xxhash64("first", last, F.lit(SEED)))
    found = windows.select("doi", "k", whole.alias("hash")).where("hash is not null")
    found = maybe(found, _mixed(F.col("k"), F.col("hash")), wholes)
    rest = found.join(keys.select("term", "k", "hash"), ["k", "hash"]).groupBy("doi", "term").agg(F.count(F.lit(1)).alias("hits"))
    return hits.unionByName(rest)
