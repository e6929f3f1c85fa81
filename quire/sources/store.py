"""The stored catalogue: papers, their index and the sync state in segments.

A commit prepares a segment under a new name (papers, document lengths, postings
and term statistics), finds what it replaces, and then writes the next version
file, which lists the segments in order, the batches they hold and the state. A
version is made visible by one rename; readers use the highest one. So a batch
that dies half way leaves files nobody lists, and a replay of a batch that a
version already holds is skipped.

A paper lives in the last segment that has its DOI. At its commit a segment looks
its DOIs up in the papers of the older ones, which are sorted by DOI and have
bloom filters: those found are its ``replaced`` table, their tokens (of these texts
alone) are taken off the term statistics, and readers anti-join older segments with
the ``replaced`` DOIs of newer ones only. No commit reads postings of the rest.

Segments are merged by size: ``max_segments`` of one tier (a power of
``max_segments`` in papers) become one segment, with the smaller ones between
them. So a paper is written again about once a tier, never at each commit.
Merged segments stay for ``grace`` versions, for readers that still use them.
All tables are spread by their sizes, never by a fixed number of buckets.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S
from quire.operators import index as IX
from quire.operators import upsert as U
from quire.operators.packed import sorted_postings
from quire.session import STORED, lean, partitions_for, size_of

MAX_SEGMENTS = 8
GRACE = 8  # versions
POINT_LOOKUP = 2000  # DOIs that go into a pushed-down filter
SMALL_BATCH = 1_000_000  # DOIs (of some 50 bytes) that a lookup may broadcast
IN_FILTER = "spark.sql.parquet.pushdown.inFilterThreshold"
BLOOM = "parquet.bloom.filter"


@dataclass
class Prepared:
    """A written segment that no version lists yet, and the rows it upserts."""

    name: str | None
    rows: int
    count: int


def forward(rows: DataFrame) -> DataFrame:
    """(doi, tokens): each document's tokens with their frequencies, from ``toks``
    (none for a document without)."""
    each = rows.select("doi", F.explode_outer(F.flatten("toks")).alias("token"))
    tf = each.groupBy("doi", "token").agg(F.count(F.lit(1)).alias("tf"))
    held = F.when(F.col("token").isNotNull(), F.struct("token", "tf"))
    return tf.groupBy("doi").agg(F.collect_list(held).alias("tokens"))


def token_stats(rows: DataFrame, sign: int) -> DataFrame:
    """(token, df, cf) of forward rows, times ``sign``."""
    each = rows.select(F.explode("tokens").alias("t")).groupBy("t.token")
    return each.agg((sign * F.count(F.lit(1))).alias("df"), (sign * F.sum("t.tf")).alias("cf"))


def due(rows: list[int], fan: int) -> int:
    """How many of the newest segments (of ``rows`` papers, oldest first) become
    one. Where ``fan`` segments of a tier stand behind all larger ones, they and
    the smaller ones between them are merged, and so on with what that gives."""
    sizes, taken = list(rows), [1] * len(rows)
    tier = lambda n: int(math.log(max(n, 1)) / math.log(max(fan, 2)) + 1e-9)
    merged = True
    while merged:
        merged = False
        for top in sorted({tier(n) for n in sizes}):
            run = next((i for i, n in enumerate(reversed(sizes)) if tier(n) > top), len(sizes))
            if run > 1 and sum(tier(n) == top for n in sizes[-run:]) >= fan:
                sizes[-run:], taken[-run:] = [sum(sizes[-run:])], [sum(taken[-run:])]
                merged = True
                break
    return taken[-1] if taken and taken[-1] > 1 else 0


class Store:
    def __init__(self, spark: SparkSession, root: str, max_segments: int = MAX_SEGMENTS, grace: int = GRACE):
        self.spark, self.root, self.max_segments, self.grace = spark, root.rstrip("/"), max_segments, grace
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions ------------------------------------------------------------------

    def version(self) -> dict:
        """The newest version: number, segments (name, rows, replaced), batches,
        sources, state, retired."""
        folder = self._path(f"{self.root}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return {"number": 0, "segments": [], "batches": [], "sources": {}, "state": {}, "retired": []}
        text = "".join(r.value for r in self.spark.read.text(f"{self.root}/versions/{max(numbers)}").collect())
        return json.loads(text)

    def _publish(self, version: dict) -> None:
        """Make ``version`` the newest; fails if another writer was first."""
        version = version | {"number": version["number"] + 1}
        draft = self._path(f"{self.root}/versions/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(version).encode())
        out.close()
        final = self._path(f"{self.root}/versions/{version['number']}")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version['number']} was written by another job")

    def state(self) -> dict[str, str]:
        return self.version()["state"]

    # -- tables --------------------------------------------------------------------

    def _read(self, segment: dict, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{segment['name']}/{table}")

    def _live(self, table: str, segments: list[dict]) -> DataFrame:
        parts = []
        for i, s in enumerate(segments):
            rows = self._read(s, table)
            newer = [f"{self.root}/{n['name']}/replaced" for n in segments[i + 1 :] if n["replaced"]]
            parts.append(rows.join(self.spark.read.parquet(*newer), "doi", "left_anti") if newer else rows)
        return reduce(DataFrame.unionByName, parts)

    def _terms(self, segments: list[dict]) -> DataFrame:
        changes = self.spark.read.parquet(*[f"{self.root}/{s['name']}/terms" for s in segments])
        return changes.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))

    def papers(self) -> DataFrame:
        segments = self.version()["segments"]
        return self._live("papers", segments).select(*S.PAPER_FIELDS) if segments else self.spark.createDataFrame([], S.PAPER_SCHEMA)

    def index(self) -> IX.Index:
        """The index of the live papers, ready for search."""
        segments = self.version()["segments"]
        if not segments:
            return IX.Index.build(self.papers())
        docs = self._live("docs", segments)
        return IX.Index(self._live("postings", segments), docs, self._terms(segments).where("df > 0"), IX.corpus_stats(docs))

    # -- writing -------------------------------------------------------------------

    def _save(self, latest: DataFrame, name: str, rows: int, text_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Papers of a segment (about so many rows and bytes of text), document lengths
        and postings, each in ranges of its key and sorted, so lookups skip files. Texts
        are tokenised again for each, which takes less than to keep their tokens."""
        at = f"{self.root}/{name}"
        n = partitions_for(self.spark, rows, text_bytes)
        latest = latest.repartitionByRange(n, "doi").sortWithinPartitions("doi")
        latest = latest.select(*S.PAPER_FIELDS, F.size(F.flatten(IX.tokens_of_fields())).alias("dl"))
        bloom = {f"{BLOOM}.enabled#doi": "true", f"{BLOOM}.expected.ndv#doi": str(max(1000, 2 * rows // n))}
        latest.write.options(**STORED, **bloom).parquet(f"{at}/papers")
        papers = self.spark.read.schema(latest.schema).parquet(f"{at}/papers")
        docs = IX.docs_from_tokens(papers).repartitionByRange(partitions_for(self.spark, rows), "doi").sortWithinPartitions("doi")
        docs.write.options(**STORED).parquet(f"{at}/docs")
        docs = self.spark.read.schema(docs.schema).parquet(f"{at}/docs")
        size = IX.corpus_stats(docs).first()
        n = partitions_for(self.spark, size.n_tokens)
        postings = sorted_postings(papers, n, size.n_docs, size.n_tokens, IX.tokens_of_fields())
        postings.write.options(**STORED).parquet(f"{at}/postings")
        return papers, docs, self.spark.read.schema(postings.schema).parquet(f"{at}/postings")

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def discard(self, new: Prepared) -> None:
        """Remove a prepared segment that is not going to be published."""
        if new.name:
            self._drop(new.name)

    def prepare(self, batch: DataFrame) -> Prepared:
        """Write the segment of ``batch`` (paper fields, ``arrival`` and, for
        records that came in pages, ``page``). Nothing lists it before
        ``publish``, so several can be prepared at once."""
        with lean(self.spark):
            return self._prepare(batch)

    def _prepare(self, batch: DataFrame) -> Prepared:
        paged = "page" in batch.columns
        name = f"segment-{uuid.uuid4().hex[:12]}"
        found = size_of(batch, "title", "abstract")
        if not found[0]:
            return Prepared(None, 0, 0)
        papers, docs, postings = self._save(U.dedup_latest(batch, page_col="page" if paged else None), name, *found)
        held = papers.select(F.explode(F.array_distinct(F.flatten(IX.tokens_of_fields()))).alias("token"))  # a DOI is one row here
        IX.counted(held, postings).write.options(**STORED).parquet(f"{self.root}/{name}/terms")
        rows = docs.count()
        return Prepared(name, rows, batch.select("page", "doi").distinct().count() if paged else rows)

    def replaced(self, segments: list[dict], dois: DataFrame, n: int) -> DataFrame:
        """(doi, tokens) of the live papers among ``dois`` (n of them)."""
        parts = []
        wanted = [r.doi for r in dois.collect()] if n <= POINT_LOOKUP else None
        for i, s in enumerate(segments):
            rows = self._read(s, "papers")
            if wanted is not None:
                rows = rows.where(F.col("doi").isin(wanted))
            else:
                rows = rows.join(F.broadcast(dois) if n <= SMALL_BATCH else dois, "doi", "left_semi")
            parts.append(rows.select("doi", IX.tokens_of_fields().alias("toks"), F.lit(i).alias("i")))
        rows = reduce(DataFrame.unionByName, parts)
        return forward(rows.groupBy("doi").agg(F.max_by("toks", "i").alias("toks")))

    def _replace(self, segments: list[dict], new: Prepared) -> dict:
        """The entry of a prepared segment behind ``segments``; its lost term
        counts and replaced DOIs are written."""
        at, count = f"{self.root}/{new.name}", 0
        if segments:
            own = self.spark.conf.get(IN_FILTER)
            self.spark.conf.set(IN_FILTER, str(POINT_LOOKUP))
            try:
                found = self.replaced(segments, self.spark.read.parquet(f"{at}/docs").select("doi"), new.rows)
                found.write.options(**STORED).parquet(f"{at}/lost")
            finally:
                self.spark.conf.set(IN_FILTER, own)
            lost = self.spark.read.parquet(f"{at}/lost")
            count = lost.count()
            if count:
                token_stats(lost, -1).write.mode("append").parquet(f"{at}/terms")
                lost.select("doi").write.parquet(f"{at}/replaced")
        return {"name": new.name, "rows": new.rows, "replaced": count}

    def _merge(self, run: list[dict], first: bool) -> dict:
        """One segment of the live rows of ``run``; ``first``: nothing is older."""
        name = f"segment-{uuid.uuid4().hex[:12]}"
        live = self._live("papers", run).select(*S.PAPER_FIELDS)
        self._save(live, name, *size_of(live, "title", "abstract"))
        terms, newer = self._terms(run), [f"{self.root}/{s['name']}/replaced" for s in run if s["replaced"]]
        (terms.where("df > 0") if first else terms.where("df <> 0 or cf <> 0")).write.parquet(f"{self.root}/{name}/terms")
        gone = 0
        if newer and not first:
            gone = sum(s["replaced"] for s in run)
            self.spark.read.parquet(*newer).distinct().write.parquet(f"{self.root}/{name}/replaced")
        return {"name": name, "rows": self._read({"name": name}, "docs").count(), "replaced": gone}

    def holds(self, version: dict, batch_id: str | None, source: tuple[str, int] | None) -> bool:
        return batch_id in version["batches"] or (source is not None and source[1] <= version["sources"].get(source[0], -1))

    def publish(
        self, new: Prepared | None, batch_id: str | None = None, state: dict[str, str | None] | None = None, source: tuple[str, int] | None = None
    ) -> int:
        """List a prepared segment, and set ``state`` (None deletes a key), in
        one version; returns the rows upserted. ``batch_id`` or ``source`` (the
        name of a stream and its number in it) is recorded against replays."""
        with lean(self.spark):
            return self._list(new, batch_id, state, source)

    def _list(self, new: Prepared | None, batch_id: str | None, state: dict[str, str | None] | None, source: tuple[str, int] | None) -> int:
        now = self.version()
        if self.holds(now, batch_id, source):
            return 0
        segments, retired = list(now["segments"]), list(now["retired"])
        if new is not None and new.name:
            segments.append(self._replace(segments, new))
        run = due([s["rows"] for s in segments], self.max_segments)
        if run:
            kept, old = segments[:-run], segments[-run:]
            segments = [*kept, self._merge(old, not kept)]
            retired += [[s["name"], now["number"] + 1] for s in old]
        drop = [name for name, at in retired if at + self.grace <= now["number"] + 1]
        self._publish(
            now
            | {
                "segments": segments,
                "batches": now["batches"] + ([batch_id] if batch_id is not None else []),
                "sources": now["sources"] | ({source[0]: source[1]} if source else {}),
                "state": {k: v for k, v in (now["state"] | (state or {})).items() if v is not None},
                "retired": [r for r in retired if r[0] not in drop],
            }
        )
        for name in drop:
            self._drop(name)
        return new.count if new is not None else 0

    def commit(
        self, batch: DataFrame | None, batch_id: str | None = None, state: dict[str, str | None] | None = None, source: tuple[str, int] | None = None
    ) -> int:
        """Upsert ``batch`` and set ``state`` in one version; returns the rows
        upserted (0 for a batch that the store already holds)."""
        if self.holds(self.version(), batch_id, source):
            return 0
        return self.publish(self.prepare(batch) if batch is not None else None, batch_id, state, source)
