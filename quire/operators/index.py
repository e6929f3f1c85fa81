"""Inverted index over the paper text fields.

Layout (all parquet, written once per build and then only read):

* ``postings(token, doi, field, pos)`` - one row per token occurrence,
  range-partitioned on ``(token, doi)`` and sorted, so parquet min/max
  statistics skip row groups for ``token = x`` / ``token LIKE 'p%'`` and a
  very common token is spread over several files instead of one;
* ``docs(doi, dl, date, category)`` - token count over all indexed fields plus
  the two filter columns, so ranking and filtering never touch the wide
  paper table;
* ``terms(token, df, cf)`` - documents and occurrences per token;
* ``corpus(n_docs, n_tokens, avgdl)`` - one row;
* ``tokens(doi, date, category, toks, dl)`` - the tokens of every field in order
  and their number, written first, so that texts are tokenised once for the others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S
from quire.functions.text import tokens
from quire.operators.packed import sorted_postings
from quire.session import STORED, lean, materialize, new_table_path, partitions_for, tasks_for

BYPASS = 6400  # partitions up to which a task's packed postings are few (3 bytes each, 96 as rows)
SPLIT_TASKS = 4  # tasks' worth of postings that one task makes from tokens


def tokens_of_fields() -> Column:
    """array<array<string>>: tokens per indexed field of a paper."""
    return F.array(*[tokens(F.col(f)) for f in S.INDEX_FIELDS])


def field_tokens(papers: DataFrame) -> DataFrame:
    """(doi, date, category, toks array<array<string>>): tokens per indexed field."""
    return papers.select("doi", "date", "category", tokens_of_fields().alias("toks"))


def dealt(tok: DataFrame, n_tokens: int) -> DataFrame:
    """``tok`` in partitions of bounded numbers of tokens. Beyond 200 partitions Spark
    sorts what a task sends to a shuffle in memory; packed postings of a split of the
    stored tokens are small until there are some thousands."""
    if tasks_for(n_tokens) <= BYPASS:
        return tok
    n = math.ceil(tasks_for(n_tokens) / SPLIT_TASKS)
    return tok.repartition(n, F.xxhash64("doi", "toks"))


def postings_from_tokens(tok: DataFrame) -> DataFrame:
    per_field = tok.select("doi", F.posexplode("toks").alias("field", "ftoks"))
    return per_field.select(
        "doi",
        F.col("field").cast("tinyint").alias("field"),
        F.posexplode("ftoks").alias("pos", "token"),
    ).select("token", "doi", "field", "pos")


def docs_from_tokens(tok: DataFrame) -> DataFrame:
    """(doi, dl, date, category); stored tokens have their number beside them."""
    dl = F.col("dl") if "dl" in tok.columns else F.size(F.flatten("toks")).alias("dl")
    return tok.select("doi", dl, "date", "category")


def build_postings(papers: DataFrame) -> DataFrame:
    return postings_from_tokens(field_tokens(papers))


def doc_lengths(papers: DataFrame) -> DataFrame:
    return docs_from_tokens(field_tokens(papers))


def term_stats(postings: DataFrame) -> DataFrame:
    """Per token: df (documents containing it) and cf (occurrences).

    Two aggregations with map-side combine, so a token that fills a third
    of the index is pre-aggregated in every task before the shuffle."""
    per_doc = postings.groupBy("token", "doi").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def term_stats_of(tok: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """:func:`term_stats` from the stored tokens of documents: df from the distinct
    tokens of each row, cf from all of them (or from stored ``postings``, where equal
    tokens lie side by side), so that only one row a token leaves a task. Rows that
    share a DOI (or have none) are one document; only those are brought together."""
    shared = tok.groupBy("doi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doi").alias("_doi"))
    shared = materialize(shared, "shared-dois")
    again = F.col("doi").eqNullSafe(F.col("_doi"))
    words = tok.select("doi", F.flatten("toks").alias("w"))
    once, several = words.join(shared, again, "left_anti"), words.join(shared, again, "left_semi")
    held = once.select(F.explode(F.array_distinct("w")).alias("token"))
    held = held.unionByName(several.select("doi", F.explode("w").alias("token")).distinct().select("token"))
    return counted(held, words.select(F.explode("w").alias("token")) if postings is None else postings)


def counted(held: DataFrame, each: DataFrame) -> DataFrame:
    """(token, df, cf) from a row for each document with a token, and for each token."""
    counts = held.select("token", F.lit(1).alias("df"), F.lit(0).alias("cf")).unionByName(each.select("token", F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return counts.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_tokens"),
    ).select(
        "n_docs",
        "n_tokens",
        F.when(F.col("n_docs") > 0, F.col("n_tokens") / F.col("n_docs")).otherwise(F.lit(0.0)).alias("avgdl"),
    )


@dataclass
class Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame
    tokens: DataFrame | None = None

    @staticmethod
    def build(papers: DataFrame) -> Index:
        """Lazily defined index (recomputed by every action that uses it)."""
        return Index.of_tokens(field_tokens(papers))

    @staticmethod
    def of_tokens(tok: DataFrame) -> Index:
        postings = postings_from_tokens(tok)
        docs = docs_from_tokens(tok)
        return Index(postings, docs, term_stats(postings), corpus_stats(docs), tok)

    def save(self, path: str) -> Index:
        """Write the tables and return an index that reads them back."""
        with lean(self.postings.sparkSession):
            return self._save(path)

    def _save(self, path: str) -> Index:
        spark = self.postings.sparkSession
        if self.tokens is not None:
            tok = self.tokens.withColumn("dl", F.size(F.flatten("toks")))
            tok.write.mode("errorifexists").options(**STORED).parquet(f"{path}/tokens")
            self = Index.of_tokens(spark.read.parquet(f"{path}/tokens"))
        (
            self.docs.repartitionByRange(partitions_for(spark, self.docs.count()), "doi")
            .sortWithinPartitions("doi")
            .write.mode("errorifexists")
            .options(**STORED)
            .parquet(f"{path}/docs")
        )
        saved_docs = spark.read.parquet(f"{path}/docs")
        size = corpus_stats(saved_docs).first()
        n = partitions_for(spark, size.n_tokens)
        if self.tokens is None:
            key = ["token", "doi", "field", "pos"]
            postings = self.postings.repartitionByRange(n, *key[:2]).sortWithinPartitions(*key)
        else:
            postings = sorted_postings(dealt(self.tokens, size.n_tokens), n, size.n_docs, size.n_tokens)
        postings.write.mode("errorifexists").options(**STORED).parquet(f"{path}/postings")
        terms = term_stats(spark.read.parquet(f"{path}/postings")) if self.tokens is None else term_stats_of(self.tokens, spark.read.parquet(f"{path}/postings"))
        terms = terms.repartitionByRange("token").sortWithinPartitions("token")
        terms.write.mode("errorifexists").options(**STORED).parquet(f"{path}/terms")
        corpus_stats(saved_docs).coalesce(1).write.mode("errorifexists").parquet(f"{path}/corpus")
        return replace(Index.load(spark, path), tokens=self.tokens)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        return Index(
            spark.read.parquet(f"{path}/postings"),
            spark.read.parquet(f"{path}/docs"),
            spark.read.parquet(f"{path}/terms"),
            spark.read.parquet(f"{path}/corpus"),
        )


def build_and_save(papers: DataFrame, path: str | None = None) -> Index:
    """Write the index of ``papers`` to the shared folder."""
    return Index.build(papers).save(path or new_table_path(papers.sparkSession, "index"))
