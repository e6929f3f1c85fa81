"""Conversations rendered from the view of each participant.

For every participant of a conversation (every role but ``system``) the whole
dialogue is rendered with that speaker as the assistant, all others as users
whose messages begin with their name, and system messages as they are. The
spans to train on are the speaker's own contents with their end marks.

A message is ``<|header|>`` newline content ``<|end|>`` newline. A rendering
comes in parts of ``PART`` messages, in order, so that a conversation of any
length is never gathered: messages are sorted by ranges of (conversation, turn,
role, text) over all tasks, and a message's number is its place in its task's
run plus the counts of the tasks before.

Defined results: a null role is a participant called '' and a null text is
empty; null turns come first; messages of one turn go by role, then text, and
repeated rows are messages each; a null conversation id is one conversation; a
conversation of system messages alone has no rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import parts_for, saved

PART = 64


def numbered(messages: DataFrame) -> DataFrame:
    """(conv_id, nr, role, text): messages with their number from 0."""
    rows = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tie", F.monotonically_increasing_id())  # equal messages are interchangeable
    by = ["conv_id", "turn", "role", "text", "tie"]
    shared = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts_for(messages, 32e6, shared), *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()
    rows = saved(rows.select("conv_id", "role", "text", F.spark_partition_id().alias("run"), place.alias("place")), "chat-sorted")
    runs = rows.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    same = rows["conv_id"].eqNullSafe(runs["c"]) & (rows["run"] == runs["r"])
    return rows.join(runs, same).select("conv_id", (F.col("base") + F.col("place") - F.col("first")).alias("nr"), "role", "text")


def header(role: Column, speaker: Column) -> Column:
    return F.when(role == "system", "system").when(role == speaker, "assistant").otherwise("user")


def content(role: Column, text: Column, speaker: Column) -> Column:
    return F.when((role == "system") | (role == speaker), text).otherwise(F.concat(role, F.lit(": "), text))


def perspectives(messages: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, n_messages, rendered, spans): spans are
    (first, end) characters of the rendered part."""
    rows = numbered(messages)
    parts = rows.groupBy("conv_id", F.floor(F.col("nr") / part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("nr", "role", "text"))).alias("m")
    )
    speakers = messages.select(F.col("conv_id").alias("c"), F.coalesce("role", F.lit("")).alias("speaker")).where("speaker <> 'system'").distinct()
    views = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["c"]))
    speaker = F.col("speaker")
    pieces = F.transform(
        "m",
        lambda x: F.struct(
            F.concat(F.lit("<|"), header(x["role"], speaker), F.lit("|>\n")).alias("head"),
            F.concat(content(x["role"], x["text"], speaker), F.lit("<|end|>")).alias("body"),
            ((x["role"] != "system") & (x["role"] == speaker)).alias("own"),
        ),
    )
    views = views.withColumn("p", pieces)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "p",
        nothing,
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["body"]) + 1).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(x["head"])).alias("first"),
                            (s["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    rendered = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    return views.select("conv_id", "speaker", "part", F.size("m").alias("n_messages"), rendered.alias("rendered"), spans.alias("spans"))


def op6_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    found = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    each = F.transform("spans", lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.select("conv_id", "speaker", "part", "n_messages", "rendered", F.array_join(each, " ").alias("spans"))


ORACLE = f"""WITH m AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS nr
  FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM m WHERE role <> 'system'),
p AS (
  SELECT conv_id, speaker, nr // {PART} AS part, nr, role = speaker AS own,
    '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END || '|>' || chr(10) AS head,
    CASE WHEN role = 'system' OR role = speaker THEN text ELSE role || ': ' || text END || '<|end|>' AS body
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.c),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY nr
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY nr) AS rendered,
  coalesce(string_agg(CAST(off + length(head) AS VARCHAR) || '-' || CAST(off + length(head) + length(body) AS VARCHAR), ' ' ORDER BY nr)
    FILTER (WHERE own), '') AS spans
FROM o GROUP BY conv_id, speaker, part"""
