"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree domain -> language -> source. A token budget goes
down from the root in proportion to the weights of sibling nodes. A node can
take no more than its capacity, ``max_epochs`` times the tokens below it; what
it can't take goes to its siblings by weight, and only if all of them are full
to the siblings of its parent, and so on. As every node is bounded by the
capacity of its whole subtree, one pass from the root does this: among the
children of a node, those with a small capacity per weight are filled first
(windows over the tree, which has a row per leaf), the rest share by weight.

Each leaf then takes whole epochs and, in a last one, the documents that come
first in a seeded order as long as their tokens fit. That prefix is found
without sorting a leaf: sums over ranges of the order tell which range holds
the cut, and only the rows of that range are ordered.

A table of target weights may name nodes of the tree; a node without one weighs
(its tokens) ** ``alpha``, so name all siblings to set plain proportions.

Only DataFrame functions are used. Tokens are estimated as a quarter of the
UTF-8 bytes, rounded up.

Defined results: null text has 0 tokens; null lang or source counts as '';
rows with the same document id in one leaf are adjacent in the order and are
taken or left together; an empty table gives an empty result. A weight of 0 or
less leaves a node out; of several weights of a node the largest counts, and
null weights are no weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import saved

SEED = 17
MAX_EPOCHS = 2
ALPHA = 0.7
BUDGET_SHARE = 1.0
ROWS_PER_RANGE = 4096
LEVELS = ("__domain", "__lang", "__source")


def domain_of(source: Column) -> Column:
    """The documents carry no domain, so one is derived from the source."""
    first = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(first < "8", F.lit("web")).otherwise(F.lit("books"))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def targets(weights: DataFrame, depth: int) -> DataFrame:
    """The weights (domain, lang, source, weight) that name nodes of a depth:
    rows whose deeper levels are null, those above them not."""
    names = [n.removeprefix("__") for n in LEVELS]
    own = weights.where("weight is not null")
    for i, n in enumerate(names):
        own = own.where(F.col(n).isNotNull() if i < depth else F.col(n).isNull())
    return own.groupBy(*[F.col(n).alias(f"__{n}") for n in names[:depth]]).agg(F.max("weight").cast("double").alias("__target"))


def allocate(leaves: DataFrame, share: float, max_epochs: int, alpha: float, weights: DataFrame | None = None) -> DataFrame:
    """Leaves (LEVELS, tokens) with their token budget as ``__budget``.

    A node's weight among its siblings is what ``weights`` says (see
    :func:`targets`), or else (its tokens) ** alpha."""
    tree = leaves.withColumn("__cap", F.col("__tokens") * max_epochs)
    budget = F.floor(F.sum("__tokens").over(Window.partitionBy(F.lit(1))) * share).cast("double")
    tree = tree.withColumn("__budget", budget)
    for depth in range(1, len(LEVELS) + 1):
        node, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        kids = tree.groupBy(*node).agg(
            F.sum("__cap").cast("double").alias("__kcap"),
            F.pow(F.sum("__tokens").cast("double"), F.lit(alpha)).alias("__w"),
            F.max("__budget").alias("__pb"),
        )
        if weights is not None:
            kids = kids.join(targets(weights, depth), node, "left")
            kids = kids.withColumn("__w", F.when(F.col("__kcap") > 0, F.coalesce("__target", "__w"))).drop("__target")
        kids = kids.where("__w > 0")
        by = Window.partitionBy(*(parent or [F.lit(1)])).orderBy(F.col("__kcap") / F.col("__w"), LEVELS[depth - 1])
        before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
        whole = Window.partitionBy(*(parent or [F.lit(1)]))
        left = F.col("__pb") - F.coalesce(F.sum("__kcap").over(before), F.lit(0.0))
        kids = kids.withColumn("__full", F.col("__kcap") * F.sum("__w").over(after) <= left * F.col("__w"))
        spare = F.col("__pb") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__kcap"))).over(whole), F.lit(0.0))
        open_w = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(whole)
        kids = kids.withColumn("__got", F.when(F.col("__full"), F.col("__kcap")).otherwise(spare * F.col("__w") / open_w))
        tree = tree.drop("__budget").join(kids.select(*node, F.col("__got").alias("__budget")), node)
    return tree.select(*LEVELS, "__rows", "__tokens", F.floor(F.col("__budget") + 1e-6).cast("long").alias("__budget"))


def mix(
    docs: DataFrame,
    share: float = BUDGET_SHARE,
    max_epochs: int = MAX_EPOCHS,
    alpha: float = ALPHA,
    seed: int = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
    weights: DataFrame | None = None,
) -> DataFrame:
    """All columns of ``docs`` for every (document, epoch) taken, and
    ``__domain``, ``__lang``, ``__source``, ``__n`` (tokens) and ``__epoch``."""
    rows = docs.withColumns(
        {
            "__domain": domain_of(F.col("source")),
            "__lang": F.coalesce(F.col("lang"), F.lit("")),
            "__source": F.coalesce(F.col("source"), F.lit("")),
            "__n": tokens_of(F.col("text")),
        }
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("__n").alias("__tokens"), F.count(F.lit(1)).alias("__rows"))
    plan = allocate(saved(leaves, "mix-leaves"), share, max_epochs, alpha, weights).withColumns(
        {
            "__whole": F.floor(F.col("__budget") / F.col("__tokens")).cast("long"),
            "__ranges": F.ceil(F.col("__rows") / rows_per_range).cast("long"),
        }
    )
    plan = saved(plan.withColumn("__rest", F.col("__budget") - F.col("__whole") * F.col("__tokens")), "mix-plan")

    def ordered(part: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
        part = part.withColumn("__key", key)
        spot = F.conv(F.substring("__key", 1, 7), 16, 10).cast("long")  # 28 bits
        return part.withColumn("__range", F.floor(spot * F.col("__ranges") / F.lit(1 << 28)).cast("long"))

    light = ordered(rows.select("doc_id", *LEVELS, "__n").join(plan, list(LEVELS)))
    sums = light.groupBy(*LEVELS, "__range", "__rest").agg(F.sum("__n").alias("__s"))
    run = Window.partitionBy(*LEVELS).orderBy("__range")
    sums = sums.withColumn("__upto", F.sum("__s").over(run))
    # the first range that no longer fits whole; none if all fit
    cut = sums.where("__upto > __rest").groupBy(*LEVELS).agg(
        F.min("__range").alias("__cut"), F.min_by(F.col("__upto") - F.col("__s"), "__range").alias("__before")
    )
    plan = saved(plan.join(cut, list(LEVELS), "left"), "mix-cuts")

    chosen = ordered(rows.join(plan, list(LEVELS)))
    inside = chosen.where("__cut is null or __range <> __cut").withColumn(
        "__more", F.coalesce(F.col("__range") < F.col("__cut"), F.lit(True))
    )
    fine = Window.partitionBy(*LEVELS, "__range").orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = chosen.where("__range = __cut").withColumn(
        "__more", F.col("__before") + F.sum("__n").over(fine) <= F.col("__rest")
    )
    taken = inside.unionByName(edge).withColumn("__copies", F.col("__whole") + F.col("__more").cast("long"))
    taken = taken.where("__copies > 0").withColumn("__epoch", F.explode(F.expr("sequence(0L, __copies - 1L)")))
    return taken.select(*docs.columns, *LEVELS, "__n", "__epoch")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mixture, one row per epoch."""
    return mix(docs).select(*docs.columns)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select(
        "doc_id",
        F.col("__epoch").alias("epoch"),
        F.col("__domain").alias("domain"),
        F.col("__lang").alias("lang"),
        F.col("__source").alias("source"),
        F.col("__n").alias("n_tokens"),
    )


def _oracle() -> str:
    levels = ["domain", "lang", "source"]
    sql = f"""WITH r AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain,
    coalesce(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 0) AS n
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS t FROM r GROUP BY ALL),
b0 AS (SELECT *, CAST(floor(sum(t) OVER () * {BUDGET_SHARE}) AS DOUBLE) AS b FROM leaf)"""
    for k in range(1, 4):
        node, up = ", ".join(levels[:k]), ", ".join(levels[: k - 1])
        part = f"PARTITION BY {up} " if up else ""
        sql += f""",
k{k} AS (SELECT {node}, CAST(sum(t) * {MAX_EPOCHS} AS DOUBLE) AS c, pow(CAST(sum(t) AS DOUBLE), {ALPHA}) AS w, max(b) AS pb
  FROM b{k - 1} GROUP BY {node} HAVING sum(t) > 0),
f{k} AS (SELECT *, c * sum(w) OVER ({part}ORDER BY c / w, {levels[k - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (pb - coalesce(sum(c) OVER ({part}ORDER BY c / w, {levels[k - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS fl FROM k{k}),
g{k} AS (SELECT {node}, CASE WHEN fl THEN c ELSE (pb - coalesce(sum(c) FILTER (WHERE fl) OVER ({part}), 0)) * w
  / sum(w) FILTER (WHERE NOT fl) OVER ({part}) END AS b FROM f{k}),
b{k} AS (SELECT domain, lang, source, t, g{k}.b FROM b{k - 1} JOIN g{k} USING ({node}))"""
    return sql + f""",
p AS (SELECT domain, lang, source, CAST(floor(b + 1e-6) AS BIGINT) AS b, t, CAST(floor(floor(b + 1e-6) / t) AS BIGINT) AS whole FROM b3),
o AS (SELECT r.doc_id, domain, lang, source, n, whole, b - whole * t AS rest,
  sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r JOIN p USING (domain, lang, source)),
c AS (SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, domain, lang, source, n AS n_tokens
FROM (SELECT *, unnest(range(copies)) AS epoch FROM c WHERE copies > 0)"""


ORACLE = _oracle()
