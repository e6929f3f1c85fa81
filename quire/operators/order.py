"""Dense positions inside groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize, partitions_of


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], name: str = "position") -> DataFrame:
    """Add a 0-based ``name`` = rank of each row inside its group by
    ``order_cols`` (which must make the order total).

    A global range-partitioned sort spreads even a very large group over many
    tasks. The sorted rows are written once, with the number of their run and
    their place in it: range bounds are sampled, so only what is written is the
    same for the counts and for the rows. Counts per (run, group) then give
    each run's offset inside the group; only that small table is windowed.
    """
    keys = [*group_cols, *order_cols]
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    srt = df.repartitionByRange(partitions_of(df, *texts), *keys).sortWithinPartitions(*keys)
    tagged = srt.withColumn("_run", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    tagged = materialize(tagged, "positions")
    runs = tagged.groupBy("_run", *group_cols).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    runs = runs.select("_first", "_offset", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(["_run", *group_cols])])
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(["_run", *group_cols])]
    return tagged.join(runs, same).select(*df.columns, (F.col("_offset") + F.col("_id") - F.col("_first")).alias(name))
