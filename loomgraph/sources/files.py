"""Files as a source: discovery, decoding and routing by extension.

Defined results: missing folders are skipped; unknown extensions and blank files give no
row; a file that cannot be read comes out with an error instead of failing the job.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

ALLOWED = (".pdf", ".docx", ".txt", ".md")
CLOUD = (".pdf", ".docx", ".pptx", ".xlsx", ".html", ".xml")


def discover(spark: SparkSession, roots: list[str], patterns: tuple[str, ...] = ("*.pdf", "*.docx", "*.txt", "*.md")) -> DataFrame:
    """``path, size, mtime`` of the files below the roots, once each; contents are not read."""
    there = [r for r in roots if "://" in r or os.path.isdir(r)]
    if not there:
        return spark.createDataFrame([], "path string, size bigint, mtime timestamp")
    glob = "{" + ",".join(patterns) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(there)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).distinct()


def read_files(spark: SparkSession, roots: list[str], patterns: tuple[str, ...] = ("*.pdf", "*.docx", "*.txt", "*.md")) -> DataFrame:
    """``path, size, mtime, sha256, extension, bytes``."""
    there = [r for r in roots if "://" in r or os.path.isdir(r)]
    if not there:
        return spark.createDataFrame([], "path string, size bigint, mtime timestamp, sha256 string, extension string, bytes binary")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(there)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), ext.alias("extension"), F.col("content").alias("bytes")).dropDuplicates(["path"])


def docx_text(data: bytes) -> str:
    """Non-blank paragraphs of a word-processor file, joined by line ends."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def pdf_text(data: bytes) -> str:
    """Text by page with ``[Page n]`` marks, where a PDF reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("no PDF reader is installed") from e
    pages = PdfReader(io.BytesIO(data)).pages
    return "".join(f"\n[Page {i}]\n{p.extract_text() or ''}" for i, p in enumerate(pages, 1)).strip()


def load_documents(files: DataFrame, cloud: Callable[[], Callable[[str, bytes], str]] | None = None) -> DataFrame:
    """``path, text, error``: plain text in generated code, other formats in Python workers.

    ``cloud`` makes a function (path, bytes) -> text for rich formats; where it fails the
    local reader is used.
    """
    utf8 = F.expr("try_validate_utf8(cast(bytes as string))")
    plain = files.where(F.col("extension").isin(".txt", ".md"))
    plain = plain.select("path", F.coalesce(utf8, F.decode("bytes", "ISO-8859-1")).alias("text"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remote = cloud() if cloud else None
        local = {".docx": docx_text, ".pdf": pdf_text}
        for b in batches:
            out = []
            for path, ext, data in zip(b["path"], b["extension"], b["bytes"]):
                text, error = None, None
                if remote is not None and ext in CLOUD:
                    try:
                        text = remote(path, bytes(data))
                    except Exception as e:
                        error = str(e)
                if text is None and ext in local:
                    try:
                        text, error = local[ext](bytes(data)), None
                    except Exception as e:
                        error = str(e)
                out.append((path, text, error))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    rich = files.where(F.col("extension").isin(*set(ALLOWED + CLOUD) - {".txt", ".md"})).select("path", "extension", "bytes")
    both = plain.unionByName(rich.mapInPandas(run, "path string, text string, error string"))
    return both.where("error is not null or trim(text) != ''")


class ParseService:
    """What a remote parser offers; without a network only the interface and a job loop exist here."""

    def submit(self, path: str) -> str:
        raise NotImplementedError

    def status(self, job: str) -> str:
        raise NotImplementedError

    def result(self, job: str) -> str:
        raise NotImplementedError


def wait_for_job(service: ParseService, job: str, most_seconds: float = 300, poll_seconds: float = 5, sleep: Callable[[float], None] | None = None) -> tuple[str, str | None]:
    """(``success`` | ``failed`` | ``timeout``, text) of a job."""
    import time

    nap, waited = sleep or time.sleep, 0.0
    while waited <= most_seconds:
        s = service.status(job).lower()
        if s in ("success", "completed"):
            return "success", service.result(job)
        if s in ("error", "failed", "cancelled"):
            return "failed", None
        nap(poll_seconds)
        waited += poll_seconds
    return "timeout", None


def folder_megabytes(spark: SparkSession, root: str) -> float:
    got = discover(spark, [root], ("*",)).agg(F.sum("size")).first()[0] or 0
    return round(got / 1048576, 2)
