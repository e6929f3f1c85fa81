"""PDF files: a per-paper sink and a bulk check with the binary-file source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema as S


def pdf_file_name(doi):
    """Column: file name of a paper's PDF (``/`` -> ``_``)."""
    return F.concat(F.replace(doi, F.lit("/"), F.lit("_")), F.lit(".pdf"))


def write_pdfs(docs: DataFrame, folder: str) -> DataFrame:
    """Sink: write ``docs(doi, content binary)`` as one file per paper into
    ``folder`` (local path or a filesystem URI such as hdfs:// or s3://),
    per partition, each file written under a temporary name and then moved,
    so a retried task leaves no partial file. Returns (doi, path, size_mb)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            paths, sizes = [], []
            for doi, content in zip(pdf["doi"], pdf["content"]):
                data = bytes(content) if content is not None else b""
                name = doi.replace("/", "_") + ".pdf"
                tmp = f"{base}/.{name}.part"
                with fs.open_output_stream(tmp) as out:
                    out.write(data)
                fs.move(tmp, f"{base}/{name}")
                paths.append(f"{folder.rstrip('/')}/{name}")
                sizes.append(round(len(data) / (1024 * 1024), 2))
            yield pd.DataFrame({"doi": pdf["doi"], "path": paths, "size_mb": sizes})

    return docs.select("doi", "content").mapInPandas(write, "doi string, path string, size_mb double")


def check_pdfs(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Every PDF file in ``folder``: size, and the status a download would
    get: 413 over the size cap, 502 without the ``%PDF`` magic, else 200.

    The binary-file scan skips zero-length files, so when the sink's
    ``manifest(path)`` is given it is the list of files and the scan only
    supplies content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    scanned = files.select(name.alias("file"), "length", F.substring("content", 1, len(S.PDF_MAGIC)).alias("magic"))
    if manifest is not None:
        listed = manifest.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("file"))
        scanned = listed.join(scanned, "file", "left").select(
            "file", F.coalesce("length", F.lit(0)).alias("length"), "magic"
        )
    status = (
        F.when(F.col("length") > S.MAX_PDF_BYTES, F.lit(413))
        .when(F.coalesce(F.col("magic") != F.lit(S.PDF_MAGIC), F.lit(True)), F.lit(502))
        .otherwise(F.lit(200))
    )
    reason = (
        F.when(status == 413, F.lit("too_large"))
        .when(status == 502, F.lit("not_pdf"))
    )
    return scanned.select(
        "file",
        F.col("length").alias("bytes"),
        F.round(F.col("length") / F.lit(1024.0 * 1024.0), 2).alias("size_mb"),
        status.alias("status"),
        reason.alias("reason"),
    )
