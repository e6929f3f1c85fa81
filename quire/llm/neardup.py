"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is the weighted set of its five-word shingles (weight: how often it
occurs). Every unit of weight of a shingle is a region in which hashed darts
land as a Poisson process in time: exponential gaps drawn from hashes of the
shingle, so equal regions have equal darts in all documents. Only darts up to
a time in inverse proportion to the document's total weight are thrown, about
k (ln k + 4) whatever its size; each goes to one of k coordinates, and the
earliest dart of a coordinate is its signature (if one is left empty, the time
is doubled). Two documents agree in a coordinate with a probability equal to
their weighted Jaccard similarity.

Joining. Bands of ``ROWS`` coordinates are keys. Copies have been collapsed
before, by text. First, every member of a bucket is paired with the bucket's
first member. Buckets that are not of one class by then go on: those of up to
``SMALL`` members give all their pairs of different classes, in larger ones the
members are paired with a head of another class, first the one with most links
and then one drawn anew each turn,
for ``TURNS`` turns or until one links nothing. These turns only join cheaply
what is near a head. The texts of large buckets that are of several classes
even then meet on their rarest shingles: the common part of two near texts is
at least ``least`` of the weight of each, so its rarest shingle comes, in order
of rarity, after at most 1 - ``least`` of the weight of either. (Any one order of
all shingles will do for that; how common one is gets counted by cells of its
hash, a table of a fixed size.) All pairs of different classes that share such a shingle go on, unless the weight left from
there, or the bits in which the parities of the shingle counts differ, rule the
similarity out; a shingle of many texts is dealt in cuts of ``CUT``. No near
pair that shares a bucket is left out, whatever the bucket's size.
Every pair is checked against the exact weighted Jaccard similarity of the
shingles, and classes are the connected components of the pairs that pass.

Defined results: words are runs of letters and digits in lower case; a text
of one to four words is one shingle; texts without words (null, empty) are a
class each, unless they are copies of one another, character by character, and
not empty; rows with equal text are always of one class; a null id counts as larger than all others.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import TEXTS, batches_of, last_stays, saved, text_keys
from quire.llm.components import components
from quire.llm.spans import Words, distinct

SIMILARITY = 0.8
SHINGLE = 5
BANDS, ROWS = 26, 5
SMALL = 32
TURNS = 2
CUT = 1000
CELLS = 1 << 20  # of hash, in which shingles are counted to order them
RANGE = 1 << 16  # of them that are summed at a time
LONGS = 8  # of parity bits
PAIRS = 500  # checked at a time
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(doc: np.ndarray, word: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each document: (document, hash, count)."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, n])
    place = np.arange(n) - np.repeat(first, size)
    left = np.repeat(size, size) - place  # words from here on
    h = np.zeros(n, np.uint64)
    for j in range(words):
        own = word[j:] * np.uint64(_ODD[j])
        h[: n - j] += np.where(left[: n - j] > j, own, np.uint64(j + 1))
    keep = (left >= words) | (place == 0)
    doc, h = doc[keep], mix64(h[keep])
    code, one = distinct(mix64(h + doc.astype(np.uint64) * np.uint64(_ODD[0])))
    return doc[one], h[one], np.bincount(code, minlength=len(one))


def darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (docs x k) of weighted sets; all 0 for an empty set."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weight, docs)
    todo = total > 0
    until = np.divide(k * (math.log(k) + 4), total, out=np.zeros(docs), where=todo)
    # a region for each unit of weight; darts past the weight of the last one don't count
    units = np.ceil(weight).astype(np.int64)
    region = np.repeat(np.arange(len(doc)), units)
    unit = np.arange(len(region)) - np.repeat(np.cumsum(units) - units, units)
    r_doc = doc[region]
    part = np.minimum(weight[region] - unit, 1.0)
    seed = mix64(element[region] + unit.astype(np.uint64) * np.uint64(_ODD[1]))
    while todo.any():
        best = np.full(docs * k, np.inf)
        name = np.zeros(docs * k, np.uint64)
        live = np.flatnonzero(todo[r_doc])
        state, time = seed[live], np.zeros(len(live))
        while len(live):
            state = mix64(state + np.uint64(_ODD[2]))
            time = time - np.log(((state >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53)
            on = time < until[r_doc[live]]
            live, state, time = live[on], state[on], time[on]
            where = mix64(state ^ np.uint64(_ODD[3]))
            inside = (mix64(where ^ np.uint64(_ODD[4])) >> np.uint64(11)).astype(float) * 2.0**-53 < part[live]
            spot = r_doc[live] * k + (where % np.uint64(k)).astype(np.int64)
            s, t, w = spot[inside], time[inside], state[inside]
            np.minimum.at(best, s, t)
            new = best[s] == t
            name[s[new]] = w[new]
        filled = np.isfinite(best).reshape(docs, k).all(1)
        done = todo & filled
        out[done] = name.reshape(docs, k)[done]
        todo &= ~filled
        until[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        key = mix64(key + signature[:, j :: rows][:, :bands] * np.uint64(_ODD[j % 5]))
    return key


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, least, weight, bands) of each different text that has
    words; least is the smallest doc_id it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            k1, k2, ids = b["k1"].to_numpy(), b["k2"].to_numpy(), b["doc_id"].to_numpy()
            for lo, hi, doc, word in words.hashes(b["text"].tolist()):
                d, s, n = shingles(doc, word)
                keys = band_keys(darts(d, s, n.astype(float), hi - lo, bands * rows), bands, rows).view(np.int64)
                weight = np.bincount(d, n, hi - lo).astype(np.int64)
                has = np.flatnonzero(weight)
                yield pd.DataFrame({"k1": k1[lo + has], "k2": k2[lo + has], "doc_id": ids[lo + has], "weight": weight[has], "bands": list(keys[has])})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInPandas(run, f"k1 long, k2 long, doc_id {kind}, weight long, bands array<long>")
    one = found.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.first("weight").alias("weight"), F.first("bands").alias("bands")
    )
    return saved(one.withColumn("id", F.monotonically_increasing_id()), "near-sketches", TEXTS)


def parities(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int) -> np.ndarray:
    """Parities of the counts by a hash of the shingle, 64 * LONGS bits a text:
    two texts differ in no more bits than their counts differ in all."""
    size = 64 * LONGS
    spot = doc * size + (mix64(shingle ^ np.uint64(_ODD[1])) % np.uint64(size)).astype(np.int64)
    odd = np.bincount(spot, count, docs * size).astype(np.int64) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, size), axis=1).view(np.int64)


def shingle_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, hashes, counts, bits) of the texts in ``nodes`` (id, k1, k2, least).

    A text is read from the rows with its smallest id: copies under other ids
    have other keys, so a large group of copies isn't one key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for b in batches:
            ids = b["id"].to_numpy()
            for lo, hi, doc, word in words.hashes(b["text"].tolist()):
                d, s, n = shingles(doc, word)
                bits = parities(d, s, n, hi - lo)
                order = np.lexsort((s, d))
                d, s, n = d[order], s[order].view(np.int64), n[order]
                cut = np.searchsorted(d, np.arange(1, hi - lo))
                yield pd.DataFrame({"id": ids[lo:hi], "hashes": np.split(s, cut), "counts": np.split(n.astype(np.int32), cut), "bits": list(bits)})

    same = (docs["k1"] == nodes["k1"]) & (docs["k2"] == nodes["k2"]) & docs["doc_id"].eqNullSafe(nodes["least"])
    rows = docs.join(nodes, same).select(docs["k1"], docs["k2"], docs["doc_id"], "id", "text")
    rows = rows.dropDuplicates(["k1", "k2", "doc_id"]).select("id", "text")
    return saved(rows.mapInPandas(run, "id long, hashes array<long>, counts array<int>, bits array<long>"), "near-shingles", TEXTS)


def similarity(a: pd.Series, na: pd.Series, b: pd.Series, nb: pd.Series) -> pd.Series:
    """Weighted Jaccard similarity of sorted hash arrays with counts."""
    out = []
    for x, n, y, m in zip(a, na, b, nb):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[i], m[j]).sum())
        out.append(both / max(int(n.sum()) + int(m.sum()) - both, 1))
    return pd.Series(out, dtype=float)


def links(pairs: DataFrame, nodes: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose similarity is ``least`` or more."""
    weight = lambda c: nodes.select(F.col("id").alias(c), F.col("weight").alias(f"{c}w"))
    side = lambda c: table.select(F.col("id").alias(c), F.col("hashes").alias(f"{c}h"), F.col("counts").alias(f"{c}n"))
    near = pairs.distinct().join(weight("u"), "u").join(weight("v"), "v")
    near = near.where(F.least("uw", "vw") >= least * F.greatest("uw", "vw")).select("u", "v")
    full = near.join(side("u"), "u").join(side("v"), "v")
    exact = F.pandas_udf(similarity, "double")
    return saved(full.where(exact("uh", "un", "vh", "vn") >= least).select("u", "v"), "near-links", PAIRS)


def all_pairs(members: DataFrame, by: list[str], least: float) -> DataFrame:
    """Pairs of different classes within groups of a bounded size."""
    lists = members.groupBy(*by).agg(F.collect_list(F.struct("id", "root", "weight")).alias("m")).where(F.size("m") > 1)
    left = lists.select(F.posexplode("m").alias("i", "a"), "m")
    b = F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")
    found = left.where(F.col("i") + 1 < F.size("m")).select("a", b).where("a.root <> b.root")
    found = found.where(F.least("a.weight", "b.weight") >= least * F.greatest("a.weight", "b.weight"))
    return found.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))


def stars(members: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of each group's head with the members of other classes."""
    return members.join(groups, by).where("root <> head.root").select(F.col("head.id").alias("u"), F.col("id").alias("v"))


MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def cell_counts(texts: DataFrame) -> DataFrame:
    """(range, cells): for each task and range of cells how often each cell has a
    shingle of ``texts``, and its least and largest root. The rows follow the tasks,
    not the shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low, high = np.zeros(CELLS, np.int64), np.full(CELLS, MOST), np.full(CELLS, LEAST)
        for b in batches:
            cell = cell_of(np.concatenate(b["hashes"].to_list()))
            root = np.repeat(b["root"].to_numpy(), b["hashes"].map(len))
            np.add.at(n, cell, 1)
            np.minimum.at(low, cell, root)
            np.maximum.at(high, cell, root)
        for k in range(0, CELLS, RANGE):
            if len(on := k + np.flatnonzero(n[k : k + RANGE])):
                packed = zlib.compress(np.stack([on, n[on], low[on], high[on]]).tobytes(), 1)
                yield pd.DataFrame({"range": [k // RANGE], "cells": [packed]})

    return texts.select("root", "hashes").mapInPandas(run, "range int, cells binary")


def rarity(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How common the shingles of ``texts`` are, and whether several classes
    have them, by cell of their hash: two arrays of CELLS bytes at any size."""

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[int, tuple] = {}  # a range is in one task; a task has few of them
        for b in batches:
            for r, packed in zip(b["range"], b["cells"]):
                on, n, low, high = np.frombuffer(zlib.decompress(packed), np.int64).reshape(4, -1)
                on = on - r * RANGE
                if r not in of:
                    of[r] = np.zeros(RANGE, np.int64), np.full(RANGE, MOST), np.full(RANGE, LEAST)
                of[r][0][on] += n
                of[r][1][on] = np.minimum(of[r][1][on], low)
                of[r][2][on] = np.maximum(of[r][2][on], high)
        for r, (n, low, high) in of.items():
            rank = np.round(8 * np.log2(np.maximum(n, 1))).astype(np.uint16)
            yield pd.DataFrame({"range": [r], "rank": [rank.tobytes()], "several": [(low < high).tobytes()]})

    dealt = cell_counts(texts).repartition(CELLS // RANGE, "range")
    rank, several = np.zeros(CELLS, np.uint16), np.zeros(CELLS, bool)
    for r in dealt.mapInPandas(whole, "range int, rank binary, several binary").collect():  # at most CELLS / RANGE rows
        s = slice(r["range"] * RANGE, (r["range"] + 1) * RANGE)
        rank[s], several[s] = np.frombuffer(r["rank"], np.uint16), np.frombuffer(r["several"], bool)
    return rank, several


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes.view(np.uint64) ^ np.uint64(_ODD[3])) % np.uint64(CELLS)).astype(np.int64)


def rarest(texts: DataFrame, rank: np.ndarray, several: np.ndarray, least: float) -> DataFrame:
    """(shingle, id, root, weight, rest, bits): of each text the shingles of
    several classes that come, the rarest first, within 1 - ``least`` of its
    weight; rest is the weight from there on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shingle, rest = [], []
            for h, n in zip(b["hashes"], b["counts"]):
                cell = cell_of(h)
                order = np.lexsort((h, rank[cell]))
                left = np.cumsum(n[order][::-1].astype(np.int64))[::-1]
                keep = (left[0] - left <= (1 - least) * left[0] + 1e-6) & several[cell[order]]
                shingle.append(h[order][keep])
                rest.append(left[keep])
            yield b[["id", "root", "weight", "bits"]].assign(shingle=shingle, rest=rest)

    found = texts.mapInPandas(run, "id long, root long, weight long, bits array<long>, shingle array<long>, rest array<long>")
    each = found.withColumn("s", F.explode(F.arrays_zip("shingle", "rest")))
    return saved(each.select(F.col("s.shingle").alias("shingle"), "id", "root", "weight", F.col("s.rest").alias("rest"), "bits"), "near-rarest", TEXTS)


def rarest_pairs(members: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """All pairs of different classes of ``members`` (id, root, weight) that can
    be near, by the shingles that are rarest among the members."""
    texts = saved(table.join(members, "id").select("id", "root", "weight", "hashes", "counts", "bits"), "near-texts")
    with batches_of(texts.sparkSession, TEXTS // 10):
        rank, several = rarity(texts)
    first = rarest(texts, rank, several, least)
    groups = first.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / CUT).cast("int").alias("cuts"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    first = first.join(groups.where("r0 <> r1").select("shingle", "cuts"), "shingle")
    a = first.withColumn("cut", F.pmod(F.xxhash64("id"), "cuts").cast("int")).drop("cuts").alias("a")
    b = first.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts").alias("b")
    other = sum((F.bit_count(F.col("a.bits")[i].bitwiseXOR(F.col("b.bits")[i])) for i in range(LONGS)), F.lit(0))
    both = F.col("a.weight") + F.col("b.weight")
    near = (F.least("a.rest", "b.rest") + 1e-6 >= least / (1 + least) * both) & (other <= (1 - least) / (1 + least) * both + 1e-6)
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.cut") == F.col("b.cut"))
    found = a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.root") != F.col("b.root")) & near)
    return found.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))


def mixed(members: DataFrame, by: list[str], turn: int) -> DataFrame:
    """Groups with several classes: their size, and a head, which is first the
    member with most links so far and then one that each turn draws anew."""
    draw = F.struct((-F.col("links") if turn == 0 else F.lit(0)).alias("a"), F.xxhash64("id", F.lit(turn)).alias("b"))
    groups = members.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by(F.struct("id", "root"), draw).alias("head")
    )
    return groups.where("r0 <> r1").drop("r0", "r1")


@last_stays
def rooted(edges: DataFrame, roots: DataFrame | None = None, new: DataFrame | None = None) -> DataFrame:
    """(id, root, links) of the nodes of ``edges``. What is known goes in as stars:
    ``roots`` of all edges but ``new`` ones, which come as edges between roots."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    if roots is None:
        return saved(components(edges).join(ends, "id"), "near-roots")
    for c in ("u", "v"):
        known = roots.select(F.col("id").alias(c), F.col("root").alias("r"))
        new = new.join(known, c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    stars = roots.select(F.col("id").alias("u"), F.col("root").alias("v")).where("u <> v")
    return saved(components(stars.unionByName(new)).join(ends, "id"), "near-roots")


@last_stays
def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL, turns: int = TURNS) -> DataFrame:
    """(k1, k2, class, links) of the texts of ``docs`` that are near another
    text: ``class`` is the same number for all texts of a class."""
    one, two = text_keys(F.col("text"))
    docs = docs.select("doc_id", "text", one.alias("k1"), two.alias("k2"))
    nodes = sketches(docs, bands, rows)
    banded = nodes.select("id", "weight", F.posexplode("bands").alias("band", "key"))
    heads = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).where("n > 1")
    heads = saved(heads, "near-buckets")
    members = banded.join(heads, ["band", "key"])
    members = saved(members.select("band", "key", "head", "id", "weight"), "near-members")
    near = nodes.join(members.select("id").distinct(), "id", "left_semi")
    table = shingle_table(docs, near.select("id", "k1", "k2", "least"))
    nodes = nodes.select("id", "k1", "k2", "weight")

    edges = links(members.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")), nodes, table, least)
    roots, bucket = rooted(edges), ["band", "key"]
    members = members.drop("head")
    for turn in range(turns):
        known = members.join(roots, "id", "left").withColumns({"root": F.coalesce("root", "id"), "links": F.coalesce("links", F.lit(0))})
        groups = saved(mixed(known, bucket, turn), "near-mixed")
        pairs = stars(known, groups.where(F.col("size") > small), bucket)
        if turn == 0:
            few = known.join(groups.where(F.col("size") <= small).select(*bucket), bucket)
            pairs = pairs.unionByName(all_pairs(few, bucket, least))
            members = saved(members.join(groups.where(F.col("size") > small).select(*bucket), bucket), "near-large")
        new = links(pairs, nodes, table, least)
        if new.limit(1).count():
            edges = edges.unionByName(new)  # of different classes, so no edge comes again
            roots = rooted(edges, roots, new)
        elif turn:
            break
    # what no head has joined
    known = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = known.groupBy(*bucket).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(*bucket)
    left = saved(known.join(groups, bucket).select("id", "root", "weight").distinct(), "near-left")
    if left.limit(1).count():
        new = links(rarest_pairs(left, table, least), nodes, table, least)
        if new.limit(1).count():
            roots = rooted(edges.unionByName(new), roots, new)
    found = roots.join(nodes, "id")
    return saved(found.select("k1", "k2", F.col("root").alias("class"), "links"), "near-classes")


def members_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, k1, k2, blank) with ``class_id``, the smallest doc_id of
    the class; a null id is used only if a class has no other."""
    by_text = docs.where("not blank").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    texts = by_text.join(found, ["k1", "k2"], "left")
    sizes = texts.where("class is not null").groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    return saved(
        texts.join(sizes, "class", "left").select(
            "k1",
            "k2",
            "least",
            "class",
            F.coalesce("class_id", "least").alias("class_id"),
            F.coalesce("class_size", "copies").alias("class_size"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        ),
        "near-members-of",
    )


def keyed(docs: DataFrame) -> DataFrame:
    one, two = text_keys(F.col("text"))
    return docs.select("doc_id", one.alias("k1"), two.alias("k2"), F.coalesce(F.col("text") == "", F.lit(True)).alias("blank"))


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays
    (one row of it); blank documents all stay."""
    texts = members_of(keyed(docs), classes(docs)).where(F.col("least").eqNullSafe(F.col("class_id")))
    single = texts.where("class is null").select("k1", "k2", "least")
    # several texts of a class can share its smallest id
    best = texts.where("class is not null").groupBy("class").agg(F.min(F.struct("k1", "k2", "least")).alias("t")).select("t.*")
    stays = single.unionByName(best).select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("least").alias("__least")
    )
    one, two = text_keys(F.col("text"))
    rows = docs.where("text <> ''").withColumns({"__k1": one, "__k2": two, "__least": F.col("doc_id")})
    same = [rows["__k1"] == stays["__k1"], rows["__k2"] == stays["__k2"], rows["__least"].eqNullSafe(stays["__least"])]
    kept = rows.join(stays, same, "left_semi").dropDuplicates(["__k1", "__k2", "__least"])
    return kept.select(*docs.columns).unionByName(docs.where("text is null or text = ''"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = keyed(docs)
    found = rows.where("not blank").join(members_of(rows, classes(docs)), ["k1", "k2"]).select("doc_id", "class_id", "class_size", "n_links")
    blank = rows.where("blank").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(blank)
