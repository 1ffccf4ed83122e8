"""Readers of files and folders, and checks of what they hold."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_html

#: Bytes and pages below which a PDF is suspect.
MIN_BYTES, MIN_PAGES = 50_000, 2
#: Tag prefixes of a manifest; more is an error.
MAX_TAGS = 10_000

MANIFEST_FIELDS = ["doc_id", "filename", "folder_key", "title", "doc_type", "language", "instrument", "celex", "publication_date", "source_url", "publisher", "status", "risk", "domain", "notes"]


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, text): every markdown file below a folder as one text."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    return x.select(_stem(F.col("path")).alias("doc_id"), "path", F.col("value").alias("text"))


def pdf_files(spark: SparkSession, folder: str, prefer: str = "en") -> DataFrame:
    """(doc_id, folder_key, language, path, size_bytes, sha256, page_count, errors, warnings) of every PDF below a folder.

    Laid out as ``.../{language}/{folder_key}/{name}.pdf``; of files with one name and folder the preferred language
    stays. Pages are counted from the file's own page objects; a file without the PDF mark is an error.
    """
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    parts = F.split("path", "/")
    text = F.decode("content", "ISO-8859-1")
    x = x.select(_stem(F.col("path")).alias("doc_id"), F.element_at(parts, -2).alias("folder_key"), F.element_at(parts, -3).alias("language"), "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
                 F.regexp_count(text, F.lit(r"/Type\s*/Page(?![a-zA-Z])")).alias("page_count"), F.substring("content", 1, 5).cast("string").startswith("%PDF").alias("pdf_valid"))
    x = x.withColumn("errors", F.filter(F.array(F.when(~F.col("pdf_valid"), F.lit("not a pdf")), F.when(F.col("size_bytes") < MIN_BYTES, F.lit("too small"))), lambda e: e.isNotNull()))
    x = x.withColumn("warnings", F.filter(F.array(F.when(F.col("page_count") < MIN_PAGES, F.lit("few pages"))), lambda e: e.isNotNull()))
    best = x.groupBy("doc_id", "folder_key").agg(F.min(F.struct((F.col("language") != prefer).alias("p"), "path")).alias("m")).select(F.col("m.path").alias("path"))
    return x.join(best, "path", "left_semi")


def parse_pdfs(files: DataFrame, parser: str = "pymupdf4llm") -> DataFrame:
    """(path, text, error): PDF to markdown with an installed parser ('pymupdf4llm', 'docling' or 'unstructured'); a missing one is an error per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(path: str) -> str:
            path = path.removeprefix("file:")
            if parser == "pymupdf4llm":
                import pymupdf4llm

                return pymupdf4llm.to_markdown(path)
            if parser == "docling":
                from docling.document_converter import DocumentConverter

                return DocumentConverter().convert(path).document.export_to_markdown()
            if parser == "unstructured":
                from unstructured.partition.pdf import partition_pdf

                return "\n\n".join(map(str, partition_pdf(path)))
            raise ValueError(f"unknown parser {parser!r}")

        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    rows.append((p, call(p), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path").mapInPandas(run, "path string, text string, error string")


def page_flags(pages: DataFrame, sample: int = 3) -> DataFrame:
    """(doc_id, has_footnotes, has_headers, hyphenation, multi_column, has_tables) from the first ``sample`` pages (doc_id, page_no, text)."""
    t = F.col("text")
    first = F.regexp_extract(t, r"^\s*([^\n]+)", 1)
    x = pages.filter(F.col("page_no") <= sample).select("doc_id", t.rlike(r"(?m)^\s*[(\[]\d{1,2}[)\]]\s+\S").alias("n"), t.rlike(r"(?m)\p{L}[-‐­¬]\s*$").alias("h"), t.rlike(r"(?m)\S {4,}\S.*\n.*\S {4,}\S").alias("c"), t.rlike(r"(?m)^\|.+\|").alias("tb"), F.lower(first).alias("first"), "page_no")
    twice = x.filter("length(first) between 5 and 90").groupBy("doc_id", "first").agg(F.count_distinct("page_no").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("hd")).distinct()
    g = x.groupBy("doc_id").agg(F.max("n").alias("has_footnotes"), F.max("h").alias("hyphenation"), F.max("c").alias("multi_column"), F.max("tb").alias("has_tables"))
    return g.join(twice, "doc_id", "left").select("doc_id", "has_footnotes", F.coalesce("hd", F.lit(False)).alias("has_headers"), "hyphenation", "multi_column", "has_tables")


def html_pages(pages: DataFrame) -> DataFrame:
    """Pages (…, html) with their text."""
    return pages.withColumn("text", clean_html(F.col("html")))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, allow: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """Rows of JSON lines with a given schema; blank lines are skipped, and with ``allow`` (key) only its keys stay."""
    raw = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)).alias("r")).select("r.*")
    return raw.join(allow.select(key).distinct(), key, "left_semi") if allow is not None else raw


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_ord, their place in (doc_id, span_start, lineage_id) order within their document."""
    from pyspark.sql import Window

    return chunks.withColumn("chunk_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("span_start", "lineage_id")))


def manifest(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, filename, folder_key, title, risk, tags): manifest entries of PDF files.

    ``tags``: (prefix, tags, prio); a prefix may end in '*'. The first prefix by prio that fits a name gives its tags.
    Names with dora, nis2 or gdpr are of high risk.
    """
    if tags.count() > MAX_TAGS:
        raise ValueError("too many tag prefixes for a hand-kept list")
    t = F.broadcast(tags.select(F.rtrim(F.col("prefix"), F.lit("*")).alias("p"), F.col("tags").alias("t"), "prio"))
    x = files.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("filename"), "folder_key")
    hit = x.join(t, F.col("doc_id").startswith(F.col("p"))).groupBy("doc_id", "folder_key").agg(F.min(F.struct("prio", "p", "t")).alias("m")).select("doc_id", "folder_key", F.col("m.t").alias("tags"))
    x = x.join(hit, ["doc_id", "folder_key"], "left")
    return x.select("doc_id", "filename", "folder_key", F.initcap(F.regexp_replace("doc_id", "[_-]+", " ")).alias("title"), F.when(F.lower("doc_id").rlike("dora|nis2|gdpr"), "high").otherwise("normal").alias("risk"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def completeness(audits: DataFrame, fields: list[str], total: int = 14) -> DataFrame:
    """(…, n_missing, n_empty, score, ok): null and blank fields, score max(0, 1 - bad / total), ok from 0.9."""
    n = lambda f: sum((F.when(f(c), 1).otherwise(0) for c in fields), F.lit(0))
    blank = lambda c: (F.size(c) == 0) if dict(audits.dtypes)[c].startswith("array") else (F.trim(F.col(c).cast("string")) == "")
    x = audits.withColumn("n_missing", n(lambda c: F.col(c).isNull())).withColumn("n_empty", n(lambda c: F.coalesce(blank(c), F.lit(False))))
    x = x.withColumn("score", F.greatest(F.lit(0.0), F.round(1 - (F.col("n_missing") + F.col("n_empty")) / float(total), 6)))
    return x.withColumn("ok", F.col("score") >= 0.9)


def cross_check(listed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, problem): 'missing' keys that are listed but not found, 'untracked' ones that are found but not listed."""
    a, b = listed.select(key).distinct().withColumn("_l", F.lit(1)), found.select(key).distinct().withColumn("_f", F.lit(1))
    return a.join(b, key, "full_outer").filter("_l is null or _f is null").select(key, F.when(F.col("_f").isNull(), "missing").otherwise("untracked").alias("problem"))
