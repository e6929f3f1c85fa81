"""Spelling variants of words: pairs one edit apart, by PartEnum signatures.

A word is the multiset of its letters, as a binary vector with one dimension per
(letter, how many of it before). One edit changes at most two bits: a replaced
letter two, an inserted or deleted one a single bit. The dimensions are dealt to
``PARTS`` parts. Of vectors that differ in two bits at least ``PARTS - 2`` parts
are equal, so all subsets of that size are signatures of words of one length; of
vectors that differ in one bit at least one of two halves of the parts is equal,
which gives the signatures between words of neighbouring lengths. Since a single
edit also leaves the letters before or those after the middle alone, each
signature is taken once with either. Pairs that are near share a signature
exactly; all that share one are joined on it and verified by their edit
distance. A signature common to very many words is split by Spark's skewed join.

The form of a word is its near word with the largest count, if that is at least
``RATIO`` times its own; counts at least double along forms, so the last form of
a chain is found by pointer doubling.

Everything is DataFrame functions.

Defined results: null and empty texts have no words; a null id counts as '' in
the hash that damages runs; repeated rows count each; an empty table gives no
rows.
"""

from __future__ import annotations

import string
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import saved, table

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
DAMAGE = 97
LETTERS = 5
OCCURS = 3
RATIO = 2
PARTS = 4
SAME, SHORT, LONG = 0, 1, 5  # two roles meet where 3 a + b is 0 (SAME, SAME) or 8 (SHORT, LONG)


def lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(docs: DataFrame, letters: int = LETTERS, occurs: int = OCCURS, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", lower(F.col("run")))
    # a run of fewer letters is no word, whole or damaged
    runs = runs.where(F.length("run") >= letters)
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")
    counted = runs.select(word).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= occurs)


def signatures(counted: DataFrame) -> DataFrame:
    """(key, role, word, n), a row per signature."""
    # letters in order, each with the number of equal ones before it, dealt to parts
    sorted_letters = F.array_sort(F.split("word", ""))
    dims = F.transform(sorted_letters, lambda x, i: F.struct(x.alias("x"), (i - F.array_position(F.col("c"), x)).alias("k")))
    rows = counted.withColumn("c", sorted_letters).withColumn("d", dims)
    part = lambda p: F.concat_ws(" ", F.transform(F.filter("d", lambda e: F.pmod(F.xxhash64(e["x"], e["k"]), F.lit(PARTS)) == p), lambda e: F.concat(e["x"], e["k"])))
    rows = rows.select("word", "n", F.length("word").alias("l"), *[part(p).alias(f"p{p}") for p in range(PARTS)])
    word, size = F.col("word"), F.col("l")

    def keys(role: int, tag: Column, before: Column, after: Column, subsets: list[tuple[int, ...]]) -> list[Column]:
        kind = F.lit(int(role == SAME))
        return [
            F.struct(F.xxhash64(kind, tag, F.lit(s), F.lit(side), half, *[F.col(f"p{p}") for p in subset]).alias("key"), F.lit(role).alias("role"))
            for s, subset in enumerate(subsets)
            for side, half in enumerate((before, after))
        ]

    half = F.floor(size / 2).cast("int")
    longer = F.floor((size + 1) / 2).cast("int")  # half of the neighbour with one letter more
    two = list(combinations(range(PARTS), PARTS - 2))
    one = [tuple(range(PARTS // 2)), tuple(range(PARTS // 2, PARTS))]
    prefix = lambda n: F.substring(word, F.lit(1), n)
    rest = lambda n: F.substring(word, n + 1, size)
    every = [
        *keys(SAME, size, prefix(half), rest(half), two),
        *keys(LONG, size, prefix(half), rest(half), one),
        *keys(SHORT, size + 1, prefix(longer), rest(longer - 1), one),
    ]
    return rows.select("word", "n", F.inline(F.array(*every)))


def near_pairs(counted: DataFrame) -> DataFrame:
    """(a, na, b, nb): each unordered pair of words one edit apart, once."""
    rows = signatures(counted)
    a = rows.select("key", F.col("role").alias("ra"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = rows.select("key", F.col("role").alias("rb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    meet = (F.col("ra") * 3 + F.col("rb")).isin(0, 3 * SHORT + LONG) & ((F.col("ra") == SHORT) | (F.col("a") < F.col("b")))
    found = a.join(b, (a["key"] == b["key"]) & meet & (F.levenshtein("a", "b", 1) == 1))
    return saved(found.select("a", "na", "b", "nb").dropDuplicates(["a", "b"]), "variant-pairs")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): the end of the chain."""
    now = saved(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        now = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n."""
    counted = saved(words(docs), "variant-words")
    pairs = near_pairs(counted)
    both = pairs.select(F.col("a").alias("word"), "na", F.col("b").alias("other"), "nb").unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("na"), F.col("a").alias("other"), F.col("na").alias("nb"))
    )
    best = F.min_by(F.struct("other", "nb"), F.struct((-F.col("nb")).alias("m"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("na").alias("na"), best)
    enough = F.col("best.nb") >= RATIO * F.col("na")
    near = saved(near.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, F.col("best.nb")).alias("form_n")), "variant-near")
    out = counted.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
