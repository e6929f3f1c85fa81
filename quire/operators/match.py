"""Match trees evaluated on the postings table, with BM25 relevance.

Plan for one query (every step is a DataFrame operation):

1. postings filtered to the query tokens (``token IN (...)`` and
   ``startswith`` for prefixes; both reach the parquet scan), joined to the
   broadcast phrase-term table (its size is bounded by the query text);
2. each posting proposes a phrase start ``pos - j``; a start with all ``k``
   phrase tokens is an occurrence (one aggregation, no k-way self-join; starts
   of common words are dealt out first, as few rows fall together before that);
3. NEAR groups: window functions per (doc, field) ordered by position find
   the nearest instance of every other member (no pairs are emitted);
4. one aggregation per document gives phrase frequencies and NEAR flags; the
   boolean tree becomes a Column over them;
5. BM25 uses stored document frequencies for single tokens (one small
   lookup of the query's tokens), a scalar subquery over the corpus for
   phrases / prefixes / column-restricted terms, and the stored corpus
   statistics;
6. an AND query is evaluated only on the documents of its rarest branch
   (bounded from stored frequencies), so the postings of a common word are
   filtered by a semi-join instead of being aggregated over the corpus.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schema as S
from quire.operators.index import Index
from quire.plans.query import And, Near, Not, Nothing, Or, Phrase, QueryError
from quire.session import literal_table, partitions_for, tasks_for

START_BYTES = 160  # of a phrase start in an aggregation, besides its row


@dataclass
class Compiled:
    tree: object
    specs: list[Phrase] = field(default_factory=list)  # distinct phrase specs
    slot_spec: list[int] = field(default_factory=list)  # BM25 phrase list -> spec
    slot_near: list[tuple[int, int] | None] = field(default_factory=list)  # -> (near, member)
    nears: list[Near] = field(default_factory=list)

    def spec_id(self, ph: Phrase) -> int:
        if ph not in self.specs:
            self.specs.append(ph)
        return self.specs.index(ph)


def compile_tree(tree) -> Compiled:
    comp = Compiled(tree)

    def walk(node):
        if isinstance(node, Phrase):
            comp.slot_spec.append(comp.spec_id(node))
            comp.slot_near.append(None)
        elif isinstance(node, Near):
            n = len(comp.nears)
            comp.nears.append(node)
            for m, ph in enumerate(node.phrases):
                comp.slot_spec.append(comp.spec_id(ph))
                comp.slot_near.append((n, m))
        elif isinstance(node, (And, Or)):
            for x in node.items:
                walk(x)
        elif isinstance(node, Not):
            walk(node.left)
            walk(node.right)

    walk(tree)
    return comp


_TERM_SCHEMA = T.StructType(
    [
        T.StructField("spec", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("fields", T.ArrayType(T.IntegerType())),
        T.StructField("initial", T.BooleanType()),
    ]
)


def occurrences(
    idx: Index,
    specs: list[Phrase],
    only: list[int] | None = None,
    docs: DataFrame | None = None,
    cf: dict[str, int] | None = None,
) -> DataFrame:
    """(doi, field, start, spec, len): every occurrence of the phrase specs
    (those in ``only`` when given), optionally restricted to ``docs(doi)``.

    ``cf`` (of :func:`token_stats`) says how many starts the phrases propose.
    Where they are more than a task holds, they are dealt out by start before they
    are counted, so that no task counts those of a whole file split."""
    spark = idx.postings.sparkSession
    exact_rows, prefix_rows = [], []
    for sid, ph in enumerate(specs):
        if only is not None and sid not in only:
            continue
        k = len(ph.tokens)
        for j, tok in enumerate(ph.tokens):
            row = (sid, j, tok, k, list(ph.fields) if ph.fields is not None else None, ph.initial)
            (prefix_rows if ph.prefix and j == k - 1 else exact_rows).append(row)
    parts = []
    post = idx.postings.select("token", "doi", "field", "pos")
    if exact_rows:
        terms = literal_table(spark, exact_rows, _TERM_SCHEMA)
        words = sorted({r[2] for r in exact_rows})
        hit = post.where(F.col("token").isin(words)).join(F.broadcast(terms), F.col("token") == F.col("term"))
        parts.append(hit)
    # prefixes of one length are an equi-join on that many leading characters
    for n in sorted({len(r[2]) for r in prefix_rows}):
        rows = [r for r in prefix_rows if len(r[2]) == n]
        cond = functools.reduce(operator.or_, [F.col("token").startswith(p) for p in sorted({r[2] for r in rows})])
        terms = F.broadcast(literal_table(spark, rows, _TERM_SCHEMA))
        parts.append(post.where(cond).join(terms, F.substring("token", 1, n) == F.col("term")))
    if not parts:
        return literal_table(spark, [], "doi string, field tinyint, start int, spec int, len int")
    hits = functools.reduce(DataFrame.unionByName, parts)
    if docs is not None:
        hits = hits.join(docs, "doi", "left_semi")
    hits = hits.select(
        "doi",
        "field",
        (F.col("pos") - F.col("j")).alias("start"),
        "spec",
        "k",
        "fields",
        "initial",
    )
    hits = hits.where(
        (F.col("start") >= 0)
        & (F.col("fields").isNull() | F.array_contains(F.col("fields"), F.col("field").cast("int")))
        & (~F.col("initial") | (F.col("start") == 0))
    )
    lengths = {len(specs[r[0]].tokens) for r in exact_rows + prefix_rows}
    out = []
    if 1 in lengths:
        out.append(hits.where(F.col("k") == 1).select("doi", "field", "start", "spec", F.col("k").alias("len")))
    if any(n > 1 for n in lengths):
        starts = hits.where(F.col("k") > 1)
        rows = sum((cf or {}).get(t, 0) for _, _, t, k, _, _ in exact_rows if k > 1)
        rows += sum((cf or {}).get(t + "*", 0) for _, _, t, k, _, _ in prefix_rows if k > 1)
        if tasks_for(rows, rows * START_BYTES) > 1:
            starts = starts.repartition(partitions_for(spark, rows, rows * START_BYTES), "doi", "field", "start")
        out.append(
            starts.groupBy("doi", "field", "start", "spec", "k")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == F.col("k"))
            .select("doi", "field", "start", "spec", F.col("k").alias("len"))
        )
    return functools.reduce(DataFrame.unionByName, out)


def near_hits(inst: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """NEAR groups over instances (near, n_members, member, dist, doi, field,
    start, len), with at most ``width`` members each: instance counts that sit
    within the distance of every other member (doi, near, member, value), and
    the documents that hold the group (doi, near, value)."""
    w = Window.partitionBy("near", "doi", "field").orderBy("start", "member")
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    for q in range(width):
        inst = inst.withColumn(
            f"pe{q}", F.max(F.when(F.col("member") == q, F.col("start") + F.col("len"))).over(before)
        ).withColumn(f"ns{q}", F.min(F.when(F.col("member") == q, F.col("start"))).over(after))
    end = F.col("start") + F.col("len")
    covered, leftmost = [], []
    for q in range(width):
        other = (F.col("member") != q) & (F.lit(q) < F.col("n_members"))
        near_left = (F.col("start") - F.col(f"pe{q}")) <= F.col("dist")
        near_right = (F.col(f"ns{q}") - end) <= F.col("dist")
        covered.append(~other | F.coalesce(near_left | near_right, near_left, near_right, F.lit(False)))
        leftmost.append(~other | F.col(f"ns{q}").isNotNull())
    last_start = F.greatest(
        *[F.when((F.col("member") != q) & (F.lit(q) < F.col("n_members")), F.col(f"ns{q}")) for q in range(width)],
        F.col("start"),
    )
    inst = inst.select(
        "doi",
        "near",
        "member",
        functools.reduce(operator.and_, covered).alias("covered"),
        (functools.reduce(operator.and_, leftmost) & ((last_start - end) <= F.col("dist"))).alias("anchor"),
    )
    counts = inst.where("covered").groupBy("doi", "near", "member").agg(F.count(F.lit(1)).alias("value"))
    held = inst.where("anchor").groupBy("doi", "near").agg(F.lit(1).cast("long").alias("value"))
    return counts, held


def near_rows(occ: DataFrame, comp: Compiled) -> DataFrame | None:
    """(doi, key, value) rows for the NEAR groups of one query."""
    if not comp.nears:
        return None
    members = [
        (n, len(near.phrases), m, comp.specs.index(ph), near.distance)
        for n, near in enumerate(comp.nears)
        for m, ph in enumerate(near.phrases)
    ]
    mem = literal_table(occ.sparkSession, members, "near int, n_members int, member int, spec int, dist int")
    inst = occ.join(F.broadcast(mem), "spec").select("near", "n_members", "member", "dist", "doi", "field", "start", "len")
    counts, held = near_hits(inst, max(len(nr.phrases) for nr in comp.nears))
    tf = counts.select("doi", F.format_string("n%d_%d", "near", "member").alias("key"), "value")
    return tf.unionByName(held.select("doi", F.format_string("f%d", "near").alias("key"), "value"))


def _slot_tf(comp: Compiled, p: int) -> Column:
    nm = comp.slot_near[p]
    name = f"s{comp.slot_spec[p]}" if nm is None else f"n{nm[0]}_{nm[1]}"
    return F.coalesce(F.col(name), F.lit(0))


def tree_column(comp: Compiled) -> Column:
    counter = iter(range(len(comp.slot_spec)))
    near_counter = iter(range(len(comp.nears)))

    def walk(node) -> Column:
        if isinstance(node, Phrase):
            p = next(counter)
            return _slot_tf(comp, p) > 0 if node.tokens else F.lit(False)
        if isinstance(node, Near):
            for _ in node.phrases:
                next(counter)
            return F.coalesce(F.col(f"f{next(near_counter)}"), F.lit(0)) > 0
        if isinstance(node, And):
            return functools.reduce(operator.and_, [walk(x) for x in node.items])
        if isinstance(node, Or):
            return functools.reduce(operator.or_, [walk(x) for x in node.items])
        if isinstance(node, Not):
            left = walk(node.left)
            return left & ~walk(node.right)
        return F.lit(False)

    return walk(comp.tree)


def simple_spec(ph: Phrase) -> bool:
    """One exact token in any field: its document frequency is stored."""
    return len(ph.tokens) == 1 and not ph.prefix and ph.fields is None and not ph.initial


def token_stats(idx: Index, specs: list[Phrase]) -> tuple[dict[str, int], dict[str, int]]:
    """Stored df and cf of the query's tokens, and for each prefix ``p`` their
    sums over tokens starting with it under key ``p*`` (that of df is an upper
    bound of the documents it matches). Prefix sums are aggregated on the
    executors, so the driver receives two numbers per query token or prefix."""
    words = sorted({t for ph in specs for t in ph.tokens})
    prefixes = sorted({ph.tokens[-1] for ph in specs if ph.prefix and ph.tokens})
    if not words:
        return {}, {}
    found = idx.terms.where(F.col("token").isin(words)).select("token", "df", "cf").collect()
    df, cf = {r.token: int(r.df) for r in found}, {r.token: int(r.cf) for r in found}
    if prefixes:
        cond = functools.reduce(operator.or_, [F.col("token").startswith(p) for p in prefixes])
        of = lambda c, p: F.sum(F.when(F.col("token").startswith(p), F.col(c)))
        sums = idx.terms.where(cond).agg(*[of(c, p).alias(f"{c}{i}") for i, p in enumerate(prefixes) for c in ("df", "cf")]).collect()[0]
        for i, p in enumerate(prefixes):
            df[p + "*"], cf[p + "*"] = int(sums[f"df{i}"] or 0), int(sums[f"cf{i}"] or 0)
    return df, cf


def doc_bound(node, specs_df) -> int:
    """Upper bound of the number of documents matching ``node``."""
    if isinstance(node, Phrase):
        if not node.tokens:
            return 0
        vals = [specs_df.get(t, 0) for t in node.tokens[:-1]]
        last = node.tokens[-1]
        vals.append(specs_df.get(last + "*", 0) if node.prefix else specs_df.get(last, 0))
        return min(vals)
    if isinstance(node, Near):
        return min(doc_bound(p, specs_df) for p in node.phrases)
    if isinstance(node, And):
        return min(doc_bound(x, specs_df) for x in node.items)
    if isinstance(node, Or):
        return sum(doc_bound(x, specs_df) for x in node.items)
    if isinstance(node, Not):
        return doc_bound(node.left, specs_df)
    return 0


def matched_docs(idx: Index, tree, *, score: bool = True) -> DataFrame:
    """(doi, dl, date, category[, score]) of the documents matching ``tree``.

    An AND query is evaluated only on the documents that satisfy its rarest
    branch (chosen from stored document frequencies), so a common word in
    the query never aggregates its postings over the whole corpus."""
    if isinstance(tree, Nothing):
        base = idx.docs.limit(0)
        return base.withColumn("score", F.lit(0.0)) if score else base
    comp = compile_tree(tree)
    if not comp.specs:
        raise QueryError("query has no phrase")
    stats, cf = token_stats(idx, comp.specs)
    docs = None
    if isinstance(tree, And) and len(tree.items) > 1:
        driver = min(tree.items, key=lambda x: doc_bound(x, stats))
        docs = matched_docs(idx, driver, score=False).select("doi")
    occ = occurrences(idx, comp.specs, docs=docs, cf=cf)
    spec_tf = occ.groupBy("doi", "spec").agg(F.count(F.lit(1)).alias("tf"))
    rows = spec_tf.select("doi", F.format_string("s%d", "spec").alias("key"), F.col("tf").alias("value"))
    nrows = near_rows(occ, comp)
    if nrows is not None:
        rows = rows.unionByName(nrows)
    keys = [f"s{i}" for i in range(len(comp.specs))]
    for n, near in enumerate(comp.nears):
        keys += [f"n{n}_{m}" for m in range(len(near.phrases))] + [f"f{n}"]
    per_doc = rows.groupBy("doi").agg(*[F.sum(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])
    per_doc = per_doc.where(tree_column(comp))
    out = per_doc.join(idx.docs, "doi")
    if not score:
        return out.select("doi", "dl", "date", "category")
    return out.select("doi", "dl", "date", "category", bm25(idx, comp, stats, cf).alias("score"))


def bm25(idx: Index, comp: Compiled, stats: dict[str, int], cf: dict[str, int]) -> Column:
    """FTS-style BM25 (higher is better) summed over the query phrase list in
    order. Document frequencies: stored for single tokens; for phrases,
    prefixes and column-restricted terms one scalar subquery over their
    occurrences in the whole corpus."""
    complex_ids = [i for i, ph in enumerate(comp.specs) if not simple_spec(ph)]
    dfmap = None
    if complex_ids:
        occ_all = occurrences(idx, comp.specs, only=complex_ids, cf=cf)
        dfmap = (
            occ_all.groupBy("spec")
            .agg(F.count_distinct("doi").alias("df"))
            .agg(F.map_from_entries(F.collect_list(F.struct("spec", "df"))).alias("m"))
            .scalar()
        )
    corpus = idx.corpus.select(F.struct(F.col("n_docs").cast("double").alias("n"), "avgdl").alias("c")).scalar()
    n_docs, avgdl = corpus["n"], corpus["avgdl"]
    k1, b = S.BM25_K1, S.BM25_B
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl)
    total = None
    for p, sid in enumerate(comp.slot_spec):
        ph = comp.specs[sid]
        if simple_spec(ph):
            df = F.lit(float(stats.get(ph.tokens[0], 0)))
        else:
            df = F.coalesce(F.try_element_at(dfmap, F.lit(sid)), F.lit(0)).cast("double")
        raw = F.ln((n_docs - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0.0, F.lit(S.IDF_FLOOR)).otherwise(raw)
        tf = _slot_tf(comp, p).cast("double")
        term = idf * ((tf * (k1 + 1.0)) / (tf + norm))
        total = term if total is None else total + term
    return total
