"""Descriptor XML for thesaurus records, with Spark's XML data source.

Layout read: ``<DescriptorRecord>`` elements, each with an id and any
number of ``.../Term/String`` values (compressed or plain files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = T.StructType([T.StructField("String", T.StringType())])
DESCRIPTOR_SCHEMA = T.StructType(
    [
        T.StructField("DescriptorUI", T.StringType()),
        T.StructField(
            "ConceptList",
            T.StructType(
                [
                    T.StructField(
                        "Concept",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "TermList",
                                        T.StructType([T.StructField("Term", T.ArrayType(_TERM))]),
                                    )
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)


def read_descriptor_xml(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, term) from descriptor XML files (gz or plain)."""
    df = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(DESCRIPTOR_SCHEMA).load(path)
    terms = F.flatten(
        F.transform(
            F.coalesce(F.col("ConceptList.Concept"), F.array()),
            lambda c: F.transform(F.coalesce(c["TermList"]["Term"], F.array()), lambda t: t["String"]),
        )
    )
    return df.select(F.col("DescriptorUI").alias("record_id"), F.explode(terms).alias("term")).where(
        F.col("term").isNotNull()
    )


def write_descriptor_xml(records: DataFrame, path: str) -> None:
    """Write (record_id, term) as descriptor XML: one concept per term. A
    record's terms are gathered into one element; records are bounded
    groups (a conversation, a descriptor)."""
    rec = records.groupBy("record_id").agg(
        F.array_sort(F.collect_list("term")).alias("terms")
    )
    out = rec.select(
        F.col("record_id").alias("DescriptorUI"),
        F.struct(
            F.transform(
                "terms", lambda t: F.struct(F.struct(F.array(F.struct(t.alias("String"))).alias("Term")).alias("TermList"))
            ).alias("Concept")
        ).alias("ConceptList"),
    )
    out.write.format("xml").option("rootTag", "DescriptorRecordSet").option("rowTag", "DescriptorRecord").mode(
        "errorifexists"
    ).save(path)
