"""Join of documents by the Jaccard similarity of their word n-grams, by
vertical partitioning.

A document is the set of its different n-grams, in the global order of their
hashes. The order is cut into fragments and a document's n-grams in a fragment
are its segment there; what two documents have in common is the sum of what
their segments have in common.

Candidates. The n-grams in which two sets differ are at most
``(100 - P) / P`` of the smaller set, so if the order is cut into more fragments
than that, some segments of the two are equal. Sizes fall into classes, each with
its number of fragments; a set that can link to the next class is cut for that as
well. A cut leaves ``slack`` fragments over, so that many segments are equal, and
segments of less than ``THIN`` n-grams say nothing unless a set has ``slack`` of
them. Equal segments are found by one key each; nothing is compared with
frequent n-grams. Equal sets have been collapsed before.

Overlaps. Candidate pairs are counted in ``FRAGMENTS`` fragments separately, as
rows of (pair, fragment), and the partial overlaps are summed per pair.

Pairs. First every member of a bucket of equal segments meets the bucket's first
member. Sets of buckets that are in several components even then are put into
families (what buckets connect), and each family gets a consensus: the n-grams
that more than half of its sets have. Let W be the number of n-grams in which a
set differs from the consensus, D those n-grams, and
s = (100 - P) n - (100 + P) W. Two sets differ in W + W' - 2 |D and D'| n-grams, so
they link if and only if s + s' + 2 (100 + P) |D and D'| >= 0. Sets with nothing
in common but the consensus therefore link only if each of them links to the set
with the largest s. All others share one of the rarest elements of D: an equi-join
on the prefixes of D in order of rarity finds them, bounded by what is left behind
the prefix. So families of any size are joined without comparing all their pairs,
and no link between two components is lost.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing; fewer words than ``WORDS`` are one n-gram; n-grams and sets
are told apart by 64 and 128 bits of hashes; rows with equal ids are documents of
their own; a null id counts as larger than all others; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import TEXTS, saved, table
from quire.llm.components import components
from quire.llm.lm import tokens
from quire.llm.neardup import _ODD, mix64, shingles
from quire.llm.spans import WordHash

WORDS = 3
PERCENT = 90
FRAGMENTS = 8
THIN = 3
GROWTH = 1.25  # of the bounds of the size classes
SMALL_SIDE = 1_000_000  # rows of 40 bytes that a join may broadcast


class Classes:
    """Size classes of sets, and how many fragments each is cut into."""

    def __init__(self, percent: int):
        self.percent = percent
        first = -(-percent // (100 - percent))  # smaller sets link only if equal
        bounds = [first]
        while bounds[-1] < 1 << 40:
            # two sets that link are of one class or of neighbouring ones
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 100 // percent + 1, int(bounds[-1] * GROWTH)))
        self.bounds = np.array(bounds, np.int64)
        differ = (self.bounds[1:] - 1) * (100 - percent) // percent
        self.slack = 2 + differ // 8
        self.fragments = differ + self.slack

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each size (-1: none), and whether it links to the next."""
        c = np.searchsorted(self.bounds, n, "right") - 1
        return c, (c >= 0) & (n * 100 // self.percent >= self.bounds[np.minimum(c + 1, len(self.bounds) - 1)])


def ngrams(texts: list, words: int, hasher: WordHash) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the texts: first and end text, and the different n-grams,
    in order, as (text counted from the first, hash)."""
    for lo, hi, doc, token in tokens(texts, hasher):
        word = np.r_[doc[1:] == doc[:-1], np.zeros(min(1, len(doc)), bool)]  # not the end of a text
        d, h, _ = shingles(doc[word], token[word], words)
        order = np.lexsort((h, d))
        yield lo, hi, d[order], h[order]


def sums(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """Sum of the hashes of each set, modulo 2**64."""
    out = np.zeros(docs, np.uint64)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.add.reduceat(h, first)
    return out


def segment_keys(doc: np.ndarray, h: np.ndarray, kind: np.ndarray, sizes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the segments of sets, each of the class ``kind`` (-1: none)."""
    pieces = np.where(kind >= 0, sizes.fragments[kind], 0)
    begin = np.cumsum(pieces) - pieces
    on = kind[doc] >= 0
    d, h = doc[on], h[on]
    fragment = ((h >> np.uint64(32)) * pieces[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    spot = begin[d] + fragment
    total = int(pieces.sum())
    size = np.bincount(spot, minlength=total)
    print_ = sums(spot, mix64(h ^ np.uint64(_ODD[2])), total)
    owner = np.repeat(np.arange(len(kind)), pieces)
    thin = size < THIN
    slack = np.where(kind >= 0, sizes.slack[kind], 0)
    many = np.bincount(owner, thin, len(kind)) >= slack
    keep = ~thin | many[owner]
    place = (np.arange(total) - begin[owner]).astype(np.uint64)
    key = mix64(print_ + mix64(place * np.uint64(_ODD[3]) + kind[owner].astype(np.uint64)) + size.astype(np.uint64))
    return owner[keep], key[keep]


def fingerprints(d: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(sums(d, mix64(h ^ np.uint64(_ODD[k])), docs).view(np.int64) for k in (0, 1))


def sketched(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, f1, f2, keys) of each row."""
    sizes, kind = Classes(percent), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHash()
        for b in batches:
            ids, text_key = b["doc_id"].to_numpy(), b["text_key"].to_numpy()
            for lo, hi, d, h in ngrams(b["text"].tolist(), words, hasher):
                n = np.bincount(d, minlength=hi - lo)
                own, next_ = sizes.of(n)
                found = [segment_keys(d, h, own, sizes), segment_keys(d, h, np.where(next_, own + 1, -1), sizes)]
                owner, key = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(1, hi - lo))
                f1, f2 = fingerprints(d, h, hi - lo)
                yield pd.DataFrame({"doc_id": ids[lo:hi], "text_key": text_key[lo:hi], "n": n, "f1": f1, "f2": f2, "keys": np.split(key[order].view(np.int64), cut)})

    return saved(docs.mapInPandas(run, f"doc_id {kind}, text_key long, n long, f1 long, f2 long, keys array<long>"), "ngram-docs", TEXTS)


def fragments(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(id, fragment, grams) of the sets in ``nodes`` (id, least, text_key, f1, f2),
    each read from one of its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHash()
        for b in batches:
            ids, e1, e2 = (b[c].to_numpy() for c in ("id", "f1", "f2"))
            for lo, hi, d, h in ngrams(b["text"].tolist(), words, hasher):
                f1, f2 = fingerprints(d, h, hi - lo)
                right = (f1 == e1[lo:hi]) & (f2 == e2[lo:hi])
                d, h = d[right[d]], h[right[d]]
                spot = d * FRAGMENTS + (h >> np.uint64(64 - FRAGMENTS.bit_length() + 1)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]) if len(spot) else np.zeros(0, np.int64)
                yield pd.DataFrame({"id": ids[lo:hi][d[first]], "fragment": (spot[first] % FRAGMENTS).astype(np.int32), "grams": np.split(h.view(np.int64), first[1:]) if len(first) else []})

    # a large group of copies has one row here, so the list is small beside the documents
    side = F.broadcast(nodes) if nodes.count() <= SMALL_SIDE else nodes
    same = docs["doc_id"].eqNullSafe(side["least"]) & (docs["text_key"] == side["text_key"])
    rows = docs.join(side, same).select("id", "f1", "f2", "text")
    found = rows.mapInPandas(run, "id long, fragment int, grams array<long>")
    return saved(found.dropDuplicates(["id", "fragment"]), "ngram-fragments", TEXTS)


def links(pairs: DataFrame, nodes: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that link: partial overlaps by fragment, summed."""
    size = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"))
    side = lambda c: cut.select(F.col("id").alias(c), "fragment", F.col("grams").alias(f"{c}g"))
    near = pairs.distinct().join(size("u"), "u").join(size("v"), "v")
    near = near.where(100 * F.least("un", "vn") >= percent * F.greatest("un", "vn"))
    each = near.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    both = each.join(side("u"), ["u", "fragment"]).join(side("v"), ["v", "fragment"])
    partial = both.select("u", "v", "un", "vn", F.size(F.array_intersect("ug", "vg")).alias("common"))
    whole = partial.groupBy("u", "v", "un", "vn").agg(F.sum("common").alias("common"))
    return saved(whole.where(100 * F.col("common") >= percent * (F.col("un") + F.col("vn") - F.col("common"))).select("u", "v"), "ngram-links")


def family_pairs(left: DataFrame, cut: DataFrame, percent: int, join) -> DataFrame:
    """Links between different components of families: ``left`` has (id, family,
    n). ``join`` verifies pairs, and returns the roots after them."""
    own, twice = 100 - percent, 2 * (100 + percent)
    sets = saved(left.join(cut, "id"), "ngram-family-sets")
    many = left.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    held = sets.select("family", "fragment", F.explode("grams").alias("gram")).groupBy("family", "fragment", "gram").agg(F.count(F.lit(1)).alias("k"))
    common = held.join(many, "family").where(2 * F.col("k") > F.col("m")).groupBy("family", "fragment").agg(F.collect_list("gram").alias("common"))
    grid = left.select("id", "family", "n", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    none = F.array().cast("array<long>")
    rows = grid.join(cut, ["id", "fragment"], "left").join(common, ["family", "fragment"], "left")
    rows = rows.withColumns({"grams": F.coalesce("grams", none), "common": F.coalesce("common", none)})
    rows = rows.select("id", "family", "n", "fragment", F.concat(F.array_except("grams", "common"), F.array_except("common", "grams")).alias("differ"))
    rows = saved(rows, "ngram-differ")
    score = own * F.first("n") - (100 + percent) * F.sum(F.size("differ"))
    scores = rows.groupBy("id", "family").agg(score.alias("s"), F.sum(F.size("differ")).alias("w"), F.first("n").alias("n"))
    best = scores.groupBy("family").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("head"), F.max("s").alias("top"))
    scores = saved(scores.join(best, "family"), "ngram-scores")
    roots = join(scores.where((F.col("s") + F.col("top") >= 0) & (F.col("id") != F.col("head"))).select(F.col("head").alias("u"), F.col("id").alias("v")))

    held = rows.select("id", "family", "fragment", F.explode("differ").alias("gram")).join(scores.select("id", "s", "w", "n", "top"), "id")
    held = saved(held.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "ngram-held")
    by = ["family", "fragment", "gram"]
    rare = held.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("k > 1")
    held = held.join(rare, by, "left").withColumn("k", F.coalesce("k", F.lit(1)))
    order = Window.partitionBy("id").orderBy("k", "fragment", "gram")
    needed = F.greatest(F.lit(1), F.ceil(-(F.col("s") + F.col("top")) / twice))
    first = held.withColumn("rest", F.col("w") - F.row_number().over(order)).where((F.col("rest") + 1 >= needed) & (F.col("r0") != F.col("r1")))
    first = saved(first.select(*by, "id", "root", "s", "n", "rest"), "ngram-prefixes")
    a, b = first.alias("a"), first.alias("b")
    meet = (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root"))
    for c in by:
        meet &= F.col(f"a.{c}") == F.col(f"b.{c}")
    meet &= F.col("a.s") + F.col("b.s") + twice * (1 + F.least("a.rest", "b.rest")) >= 0
    meet &= 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return join(a.join(b, meet).select(F.col("a.id").alias("u"), F.col("b.id").alias("v")))


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = sketched(docs, words, percent)
    one = F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    nodes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), one.alias("text_key"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = saved(nodes.withColumn("id", F.monotonically_increasing_id()), "ngram-sets", TEXTS)

    keyed = nodes.select("id", F.explode("keys").alias("key"))
    heads = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("head")).where("k > 1").drop("k"), "ngram-heads")
    members = saved(keyed.join(heads, "key"), "ngram-members")
    near = nodes.join(members.select("id").distinct(), "id", "left_semi")
    cut = fragments(docs, near.select("id", "least", "text_key", "f1", "f2"), words)
    nodes = nodes.drop("keys")

    edges = links(members.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")), nodes, cut, percent)
    roots = components(edges)

    def join(pairs: DataFrame) -> DataFrame:
        """The roots with the links among ``pairs``. Known components go in as
        stars, so only what new links connect takes further rounds."""
        nonlocal roots
        new = links(pairs, nodes, cut, percent)
        if new.limit(1).count():
            roots = components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(new))
        return roots

    known = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    stars = members.join(apart, "key").select(F.col("head").alias("u"), F.col("id").alias("v"))
    families = components(stars)
    left = saved(families.join(nodes.select("id", "n"), "id").withColumnRenamed("root", "family"), "ngram-families")
    if left.limit(1).count():
        roots = family_pairs(left, cut, percent, join)

    found = nodes.join(roots, "id")
    names = found.groupBy("root").agg(F.min("least").alias("component"))
    found = saved(found.join(names, "root").select("f1", "f2", "component"), "ngram-components")
    sets = nodes.join(found, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("component", "least").alias("component"))
    whole = rows.where("n > 0").select("doc_id", "n", "f1", "f2").join(sets, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return whole.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) END) AS g FROM docs),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
near AS MATERIALIZED (
  SELECT u, v FROM common JOIN sizes su ON su.doc_id = u JOIN sizes sv ON sv.doc_id = v
  WHERE 100 * c >= {PERCENT} * (su.n + sv.n - c)),
edges AS MATERIALIZED (SELECT u, v FROM near UNION ALL SELECT v, u FROM near),
reach(doc_id, other) AS (SELECT u, v FROM edges UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""
