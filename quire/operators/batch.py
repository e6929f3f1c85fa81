"""Many saved keyword queries searched in one job.

Saved queries are a table ``(qid, text)``. Preparation, thesaurus grouping
and expansion, matching, ranking and the per-query top-k are all DataFrame
operations; no query is looped over on the driver.

* words: blank-separated, punctuation removed, hyphen compounds as phrases;
* mode: a quote or an upper-case operator word (AND/OR/NOT) means operator
  syntax; a word that is an operator only in lower case turns expansion off
  (every word is then a plain clause), otherwise words are grouped into
  thesaurus phrases and each clause is the term OR its synonyms;
* clauses -> alternatives -> phrases (token arrays, last token may be a
  prefix); each distinct phrase is evaluated once for all queries;
* every query, of words or of operator syntax, becomes a row with a small
  program in postfix order over its phrases. Folds over it tell which phrases
  drive the query and whether a document matches.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schema as S
from quire.functions.text import tokens
from quire.operators import thesaurus as TH
from quire.operators.index import Index
from quire.operators.match import near_hits
from quire.plans.query import OPERATOR_WORDS, QueryError, Rows, phrase_key, rows_of
from quire.session import materialize

SPLIT_BLANKS = r"[\t\n\x0B\f\r ]+"
WORD_PARTS = r"([\p{L}\p{N}_*]+)"


def search_words(text: Column) -> Column:
    """array<string>: the sanitised words of a query text."""
    raws = F.filter(F.split(text, SPLIT_BLANKS), lambda r: r != "")

    def one(raw: Column) -> Column:
        parts = F.regexp_extract_all(raw, F.lit(WORD_PARTS), 1)
        return F.when(
            raw.contains("-") & (F.size(parts) > 1),
            F.array(F.concat(F.lit('"'), F.array_join(parts, " "), F.lit('"'))),
        ).otherwise(parts)

    return F.flatten(F.transform(raws, one))


def read(queries: DataFrame) -> DataFrame:
    """(qid, text, words, mode) of every query."""
    text = F.coalesce("text", F.lit("")).alias("text")
    words = queries.select("qid", text, search_words(text).alias("words"))
    plain = F.filter("words", lambda w: ~w.startswith('"'))
    has_upper_op = F.exists(plain, lambda w: w.isin(*OPERATOR_WORDS[:3]))
    has_lower_op = F.exists(plain, lambda w: F.upper(w).isin(*OPERATOR_WORDS))
    mode = (
        F.when(F.col("text").contains('"') | has_upper_op, "operator")
        .when(F.size("words") == 0, "empty")
        .when(has_lower_op, "plain")
        .otherwise("keyword")
    )
    return words.withColumn("mode", mode)


def prepare(queries: DataFrame) -> DataFrame:
    """(qid, mode, wpos, word): ``mode`` is 'keyword', 'plain' (expansion
    off), 'operator' (operator syntax) or 'empty' when no word survives."""
    return read(queries).select("qid", "mode", F.posexplode_outer("words").alias("wpos", "word"))


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT, _INT, _FLAG = T.StringType(), T.IntegerType(), T.BooleanType()
_ROWS = _struct(
    error=_FLAG,
    program=T.ArrayType(_struct(op=_TEXT, arg=_INT)),
    slots=T.ArrayType(_struct(slot=_INT, key=_TEXT, df_key=_TEXT, scored=_FLAG)),
    phrases=T.ArrayType(_struct(key=_TEXT, toks=T.ArrayType(_TEXT), prefix=_FLAG, fields=T.ArrayType(_INT), initial=_FLAG)),
    nears=T.ArrayType(_struct(key=_TEXT, dist=_INT, members=T.ArrayType(_TEXT))),
)


@F.pandas_udf(_ROWS)
def operator_rows(texts: pd.Series) -> pd.DataFrame:
    """Queries in operator syntax as rows; ``error`` marks broken syntax."""
    out = []
    for text in texts:
        try:
            r, error = rows_of(text), False
        except QueryError:
            r, error = Rows(), True
        phrases = [(k, list(p.tokens), p.prefix, None if p.fields is None else list(p.fields), p.initial) for k, p in r.phrases.items()]
        nears = [(k, n.distance, [phrase_key(p) for p in n.phrases]) for k, n in r.nears.items()]
        out.append((error, r.program, r.slots, phrases, nears))
    return pd.DataFrame(out, columns=["error", "program", "slots", "phrases", "nears"])


def _phrase_parts(word: Column) -> Column:
    """A search word as FTS barewords: runs split at '*', each optionally a
    prefix. Returns array<struct<toks:array<string>, prefix:boolean>>."""
    pieces = F.regexp_extract_all(word, F.lit(r"([^*]+\*?)"), 1)
    return F.filter(
        F.transform(
            pieces,
            lambda p: F.struct(tokens(F.regexp_replace(p, r"\*$", "")).alias("toks"), p.endswith("*").alias("prefix")),
        ),
        lambda s: F.size(s["toks"]) > 0,
    )


def clause_table(prepared: DataFrame, records: DataFrame | None) -> DataFrame:
    """(qid, clause, alt, part, toks, prefix): clause = AND position, alt = OR
    alternative, part = AND-ed piece inside an alternative (a word like
    ``a*b`` is ``a* AND b``)."""
    usable = prepared.where(F.col("mode").isin("keyword", "plain") & F.col("word").isNotNull())
    quoted = usable.where(F.col("word").startswith('"'))
    plain_words = usable.where(~F.col("word").startswith('"'))
    # Clauses from hyphen phrases: one alternative, the phrase itself.
    q_clauses = quoted.select(
        "qid",
        F.col("wpos").alias("clause"),
        F.lit(0).alias("alt"),
        F.array(F.struct(tokens(F.col("word")).alias("toks"), F.lit(False).alias("prefix"))).alias("parts"),
    )
    # Plain words: grouped into thesaurus phrases in keyword mode.
    plain_mode = plain_words.where(F.col("mode") == "plain").select(
        "qid", F.col("wpos").alias("clause"), F.col("word").alias("term"), F.lit(1).alias("n_words")
    )
    kw = plain_words.where(F.col("mode") == "keyword")
    if records is not None:
        kw_lists = kw.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("wpos", "word"))).alias("ws"))
        grouped = TH.group_phrases(records, kw_lists, "qid", F.transform("ws", lambda x: x["word"]))
        # group start index -> original word position
        pos_map = kw.select("qid", "wpos", F.row_number().over(Window.partitionBy("qid").orderBy("wpos")).alias("rk"))
        kw_groups = grouped.join(
            pos_map.select(F.col("qid").alias("id"), (F.col("rk") - 1).alias("start"), "wpos"), ["id", "start"]
        ).select(F.col("id").alias("qid"), F.col("wpos").alias("clause"), F.col("phrase").alias("term"), "n_words")
    else:
        kw_groups = kw.select("qid", F.col("wpos").alias("clause"), F.col("word").alias("term"), F.lit(1).alias("n_words"))
    groups = plain_mode.unionByName(kw_groups)
    term_alt = groups.select(
        "qid",
        "clause",
        F.lit(0).alias("alt"),
        F.when(
            F.col("n_words") > 1,
            F.array(F.struct(tokens(F.col("term")).alias("toks"), F.lit(False).alias("prefix"))),
        )
        .otherwise(_phrase_parts(F.col("term")))
        .alias("parts"),
    )
    alts = q_clauses.unionByName(term_alt)
    if records is not None:
        kw_terms = kw_groups
        syns = TH.expand(records, kw_terms.select(F.lower("term").alias("term")).distinct(), S.SEARCH_SYNONYMS)
        syn_alts = kw_terms.withColumn("term", F.lower("term")).join(syns, "term").select(
            "qid",
            "clause",
            F.col("rank").cast("int").alias("alt"),
            F.array(F.struct(tokens(F.col("syn")).alias("toks"), F.lit(False).alias("prefix"))).alias("parts"),
        )
        alts = alts.unionByName(syn_alts)
    return alts.select("qid", "clause", "alt", F.posexplode("parts").alias("part", "ph")).select(
        "qid", "clause", "alt", "part", F.col("ph.toks").alias("toks"), F.col("ph.prefix").alias("prefix")
    ).where(F.size("toks") > 0)


def _phrase_key(toks: Column, prefix: Column) -> Column:
    return F.concat(F.array_join(toks, " "), F.when(prefix, F.lit("*")).otherwise(F.lit("")))


@dataclass
class Plans:
    """All queries as rows: ``programs(qid, program)``, ``slots(qid, slot, key,
    df_key, scored)``, and the different ``phrases(key, toks, prefix, fields,
    initial)`` and ``nears(key, dist, members)`` that slots name."""

    programs: DataFrame
    slots: DataFrame
    phrases: DataFrame
    nears: DataFrame


_STEP = "struct<op: string, arg: int>"


def _step(op: str, arg: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), arg.cast("int").alias("arg"))


def _joined(parts: Column, op: str) -> Column:
    """The programs ``parts`` one after the other, and ``op`` over all if there
    are several."""
    last = F.when(F.size(parts) > 1, F.array(_step(op, F.size(parts)))).otherwise(F.array().cast(f"array<{_STEP}>"))
    return F.concat(F.flatten(parts), last)


def plan(queries: DataFrame, records: DataFrame | None) -> Plans:
    """Keyword queries are an AND over clauses of an OR over alternatives of an
    AND over parts; operator queries are what their syntax says."""
    order = Window.partitionBy("qid").orderBy("clause", "alt", "part")
    clauses = clause_table(prepare(queries), records).withColumn("key", _phrase_key(F.col("toks"), F.col("prefix")))
    clauses = materialize(clauses.withColumn("slot", F.row_number().over(order) - 1), "batch-clauses")
    ops = read(queries).where("mode = 'operator'").select("qid", operator_rows("text").alias("p")).select("qid", "p.*")
    ops = materialize(ops, "batch-operators")

    def sorted_programs(place: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(place, "program"))), lambda x: x["program"])

    steps = clauses.withColumn("program", F.array(_step("has", F.col("slot"))))
    for by, place, op in ((["qid", "clause", "alt"], "part", "and"), (["qid", "clause"], "alt", "or"), (["qid"], "clause", "and")):
        steps = steps.groupBy(*by).agg(sorted_programs(place).alias("parts")).withColumn("program", _joined(F.col("parts"), op))
    programs = steps.select("qid", "program").unionByName(ops.where("size(program) > 0").select("qid", "program"))
    slots = clauses.select("qid", "slot", "key", F.col("key").alias("df_key"), F.lit(True).alias("scored"))
    slots = slots.unionByName(ops.select("qid", F.inline("slots")))
    nothing = F.lit(None).cast("array<int>").alias("fields")
    phrases = clauses.select("key", "toks", "prefix", nothing, F.lit(False).alias("initial"))
    phrases = phrases.unionByName(ops.select(F.inline("phrases"))).dropDuplicates(["key"])
    nears = ops.select(F.inline("nears")).dropDuplicates(["key"])
    return Plans(*(materialize(t, f"batch-{n}") for t, n in ((programs, "programs"), (slots, "slots"), (phrases, "phrases"), (nears, "nears"))))


def _run(program: Column, has, step, kind: str) -> Column:
    """The value a program leaves: ``has(slot)`` is a slot's, ``step(op, values)``
    joins the last n; values are of the type ``kind``."""

    def one(stack: Column, x: Column) -> Column:
        kept = F.size(stack) - x["arg"]
        new = F.concat(F.slice(stack, F.lit(1), kept), F.array(step(x["op"], F.slice(stack, kept + 1, x["arg"]))))
        return F.when(x["op"] == "has", F.concat(stack, F.array(has(x["arg"])))).otherwise(new)

    return F.aggregate(program, F.array().cast(f"array<{kind}>"), one)[0]


def holds(program: Column, hit: Column) -> Column:
    """Whether a document that hits the slots ``hit`` matches."""

    def step(op: Column, v: Column) -> Column:
        return F.when(op == "and", ~F.array_contains(v, False)).when(op == "or", F.array_contains(v, True)).otherwise(v[0] & ~v[1])

    return _run(program, lambda slot: F.array_contains(hit, slot), step, "boolean")


def driver_slots(program: Column, df: Column) -> Column:
    """Slots of which every match hits at least one, chosen to be rare: of an
    AND the branch with the lowest bound, of an OR all, of a NOT the left side.
    ``df`` maps slots to document frequencies."""

    def has(slot: Column) -> Column:
        return F.struct(F.coalesce(F.try_element_at(df, slot), F.lit(0).cast("long")).alias("b"), F.array(slot).alias("slots"))

    def step(op: Column, v: Column) -> Column:
        total = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x["b"])
        both = F.struct(total.alias("b"), F.flatten(F.transform(v, lambda x: x["slots"])).alias("slots"))
        return F.when(op == "and", F.array_min(v)).when(op == "or", both).otherwise(v[0])

    return _run(program, has, step, "struct<b: bigint, slots: array<int>>")["slots"]


def _word_hits(post: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of ``post`` with the parts whose term they have or, for prefixes,
    begin with."""
    hits = post.join(parts.where(~F.col("is_prefix")), F.col("token") == F.col("term"))
    # Prefixes become equi-joins on the token's leading characters, one key
    # per distinct prefix length (at most the longest word).
    pre_terms = parts.where("is_prefix").withColumn("plen", F.length("term"))
    lengths = sorted(r[0] for r in pre_terms.select("plen").distinct().collect())
    if lengths:
        head = F.array(*[F.struct(F.lit(n).alias("plen"), F.substring("token", 1, n).alias("head")) for n in lengths])
        heads = post.select("*", F.explode(head).alias("h")).where(F.length("token") >= F.col("h.plen"))
        same = (F.col("h.head") == F.col("term")) & (F.col("h.plen") == F.col("plen"))
        hits = hits.unionByName(heads.join(pre_terms, same).drop("h", "plen"))
    return hits


def _placed(hits: DataFrame) -> DataFrame:
    """Hits with the start of their phrase, where that may be."""
    hits = hits.withColumn("start", F.col("pos") - F.col("j"))
    hits = hits.where((F.col("start") >= 0) & (~F.col("initial") | (F.col("start") == 0)))
    return hits.where(F.col("fields").isNull() | F.array_contains("fields", F.col("field").cast("int")))


def _pairs(parts: DataFrame, toks: DataFrame) -> DataFrame:
    """Hits of the pairs of neighbours in phrases of several tokens. Two common words
    of a phrase are seldom side by side, while each alone is found at each of its
    occurrences, for each phrase it is in."""
    pairs = parts.where("next_term is not null").withColumn("is_prefix", F.col("prefix") & (F.col("j") == F.col("k") - 2))
    fields = toks.select("doi", F.posexplode("toks").alias("field", "t")).where(F.size("t") > 1)
    n = F.size("t") - 1
    zipped = F.arrays_zip(F.slice("t", F.lit(1), n).alias("token"), F.slice("t", F.lit(2), n).alias("next"))
    rows = fields.select("doi", F.col("field").cast("tinyint").alias("field"), F.posexplode(zipped).alias("pos", "x"))
    rows = rows.select("doi", "field", "pos", "x.token", "x.next")
    whole = rows.join(pairs.where(~F.col("is_prefix")), (F.col("token") == F.col("term")) & (F.col("next") == F.col("next_term")))
    begun = rows.join(pairs.where("is_prefix"), (F.col("token") == F.col("term")) & F.startswith("next", "next_term"))
    return whole.unionByName(begun)


def _occurrences(hits: DataFrame, units: str) -> DataFrame:
    """Starts with as many hits as the phrase has ``units``."""
    each = _placed(hits).groupBy("key", "doi", "field", "start", "k").agg(F.count(F.lit(1)).alias("n"))
    return each.where(f"n = {units}").drop("n")


def phrase_hits(idx: Index, plans: Plans) -> DataFrame:
    """(key, doi, tf): how often each phrase, and each member of a NEAR group
    near the others, occurs in a document; 1 for a NEAR group (``...#``) as such.

    Postings are cut to the words of the queries by one join; a start with all
    tokens of a phrase, or all pairs of neighbours, is an occurrence. Each phrase is evaluated once."""
    parts = plans.phrases.select(
        "key", "prefix", "fields", "initial", "toks", F.size("toks").alias("k"), F.posexplode("toks").alias("j", "term")
    ).withColumn("is_prefix", F.col("prefix") & (F.col("j") == F.col("k") - 1))
    ahead = F.when(F.col("j") < F.col("k") - 1, F.get("toks", F.col("j") + 1)).alias("next_term")
    parts = parts.select("*", ahead).drop("toks")
    post = idx.postings.select("token", "doi", "field", "pos")
    # The part table grows with the number of saved queries, so no broadcast
    # hint: AQE broadcasts it only when its measured size allows.
    words = parts.where("k = 1")
    single = _placed(_word_hits(post, words)).select("key", "doi", "field", "start", "k")
    several = parts.where("k > 1")
    if idx.tokens is None:
        longer = _occurrences(_word_hits(post, several), "k")
    else:
        # rows that share a DOI (or have none) are one document, as their postings are
        shared = idx.docs.groupBy("doi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doi").alias("_doi"))
        shared = materialize(shared, "shared-dois")
        again = F.col("doi").eqNullSafe(F.col("_doi"))
        longer = _occurrences(_pairs(several, idx.tokens.join(shared, again, "left_anti")), "k - 1")
        longer = longer.unionByName(_occurrences(_word_hits(post.join(shared, again, "left_semi"), several), "k"))
    occ = single.unionByName(longer)
    tf = occ.groupBy("key", "doi").agg(F.count(F.lit(1)).alias("tf"))
    width = plans.nears.agg(F.max(F.size("members"))).first()[0]
    if width:
        members = plans.nears.select(F.col("key").alias("near"), "dist", F.size("members").alias("n_members"), F.posexplode("members").alias("member", "key"))
        inst = occ.withColumnRenamed("k", "len").join(members, "key").drop("key")
        counts, held = near_hits(inst, width)
        tf = tf.unionByName(counts.select(F.format_string("%s#%d", "near", "member").alias("key"), "doi", F.col("value").alias("tf")))
        tf = tf.unionByName(held.select(F.concat("near", F.lit("#")).alias("key"), "doi", F.col("value").alias("tf")))
    return materialize(tf, "batch-tf")


def batch_search(idx: Index, queries: DataFrame, records: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(qid, rank, doi, score): the top ``k`` documents of every query by BM25
    (ties: doi). A query with broken syntax has no rows (see :func:`zero_hits`).

    Each query is a program over slots (its phrases). It is driven by a rare
    set of slots that every match hits one of; frequencies, truth and scores are
    computed for (query, document with such a hit) pairs only - a common word
    shared by many queries never pairs every query with every document that
    contains it. One aggregation per pair gathers its slots, at most as many as
    the query has; the program's value over them and the score come from it."""
    plans = plan(queries, records)
    tf = phrase_hits(idx, plans)
    df = materialize(tf.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "batch-df")
    known = plans.slots.join(df.withColumnRenamed("key", "df_key"), "df_key", "left")
    known = known.withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    by_slot = known.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "df"))).alias("dfs"))
    drivers = plans.programs.join(by_slot, "qid").select("qid", F.explode(driver_slots(F.col("program"), F.col("dfs"))).alias("slot"))
    drivers = drivers.join(plans.slots, ["qid", "slot"]).select("qid", "key").distinct()
    pairs = tf.join(drivers, "key").select("qid", "doi").distinct()
    rows = pairs.join(known, "qid").join(tf, ["doi", "key"]).join(idx.docs.select("doi", "dl"), "doi")
    corpus = idx.corpus.select(F.struct(F.col("n_docs").cast("double").alias("n"), "avgdl").alias("c")).scalar()
    n_docs, avgdl = corpus["n"], corpus["avgdl"]
    k1, b = S.BM25_K1, S.BM25_B
    raw = F.ln((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0.0, F.lit(S.IDF_FLOOR)).otherwise(raw)
    t = F.col("tf").cast("double")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    rows = rows.select("qid", "doi", "slot", F.when(F.col("scored"), idf * ((t * (k1 + 1.0)) / (t + norm))).alias("c"))
    found = rows.groupBy("qid", "doi").agg(F.array_sort(F.collect_list(F.struct("slot", "c"))).alias("hit"))
    matched = found.join(plans.programs, "qid").where(holds(F.col("program"), F.col("hit.slot")))
    score = F.aggregate("hit", F.lit(0.0), lambda acc, x: acc + F.coalesce(x["c"], F.lit(0.0)))
    scored = matched.select("qid", "doi", score.alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doi"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), "doi", F.round("score", 6).alias("score"))


def zero_hits(queries: DataFrame, hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Saved queries without a result: (qid, searched, reason), with the size of
    the corpus and one of ``empty_corpus``, ``bad_syntax``, ``no_words`` and
    ``no_match``."""
    n = papers.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    missing = read(queries.join(hits.select("qid").distinct(), "qid", "left_anti"))
    broken = missing.where("mode = 'operator'").select("qid", operator_rows("text")["error"].alias("broken")).where("broken")
    reason = (
        F.when(n == 0, "empty_corpus")
        .when(F.col("broken"), "bad_syntax")
        .when(F.col("mode") == "empty", "no_words")
        .otherwise("no_match")
    )
    return missing.join(broken, "qid", "left").select("qid", n.alias("searched"), reason.alias("reason"))
