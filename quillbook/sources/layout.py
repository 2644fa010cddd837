"""Source relations: pages, cells and words of documents, OCR sidecars, folders of files, and what was read before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PAGES = "source_file string, page_no int, text string, ocr_text string"
CELLS = "source_file string, page_no int, table_no int, row_no int, cells array<string>"
WORDS = "source_file string, page_no int, text string, x0 double, x1 double, top double, bottom double, upright boolean"


def folder(spark: SparkSession, path: str, any_case: bool = False) -> DataFrame:
    """PDF files of one folder, not below it. Names are unique: of those equal but for case, later ones get __2, __3, …"""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]" if any_case else "*.pdf").load(path)
    if files.select("path").isEmpty():
        raise ValueError(f"no PDF files in {path}")
    name = F.regexp_extract("path", r"[^/]+$", 0)
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy("path"))
    return files.withColumn("n_", n).withColumn("source_file", F.when(F.col("n_") == 1, name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("__"), F.col("n_").cast("string"), F.lit("."), F.regexp_extract(name, r"[^.]+$", 0)))).drop("n_")


def configured_folder(spark: SparkSession, config: DataFrame, doc_type: str) -> str:
    """The path that a (DocType, FolderPath) table gives for a type of document."""
    rows = config.where(F.col("DocType") == doc_type).select("FolderPath").limit(1).collect()
    if not rows or not (rows[0][0] or "").strip():
        raise ValueError(f"no folder is configured for {doc_type}")
    return rows[0][0].strip()


def ocr_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """source_file and pages of <name>.ocr.txt files: form feeds part pages, blank ones are dropped."""
    rows = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.ocr.txt").withColumn("name", F.regexp_extract(F.input_file_name(), r"[^/]+$", 0))
    return rows.select(F.regexp_replace("name", r"\.ocr\.txt$", "").alias("source_file"), ocr_pages(F.col("value")).alias("ocr_pages"))


def ocr_pages(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, "\f"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def documents(pages: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """One row a document: pages, text, needs_ocr, sparse_text, ocr_used, error, warnings. Scanned pages are replaced by OCR where
    there is any. A first page of under 20 characters means a scan; under 80 characters a page on average is sparse. If pages
    tells errors, `error` is what the reader said of a file that it couldn't read, or of which it could read no page, and
    `warnings` are what it said of single pages, in page order; these are empty texts."""
    said = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    whole, single = said.isNotNull() & F.col("page_no").isNull(), said.isNotNull() & F.col("page_no").isNotNull()
    error = F.when(F.max(whole) | (F.count_if(said.isNull()) == 0), F.coalesce(F.max(F.when(whole, said)), F.max(said)))
    each = F.when(single, F.struct("page_no", F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(": "), said).alias("w")))
    warnings = F.transform(F.array_sort(F.collect_list(each)), lambda x: x["w"])
    got = pages.groupBy("source_file").agg(error.alias("error"), warnings.alias("warnings"), F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce(F.trim("text"), F.lit("")).alias("t")))), lambda x: x["t"]).alias("native"))
    got = got.join(sidecars, "source_file", "left") if sidecars is not None else got.withColumn("ocr_pages", F.lit(None).cast("array<string>"))
    got = preflight(got, "native")
    use = F.col("needs_ocr") & (F.size(F.coalesce("ocr_pages", F.array())) > 0)
    got = got.withColumns({"ocr_used": use, "pages": F.when(use, F.col("ocr_pages")).otherwise(F.col("native"))})
    return got.withColumns({"text": F.array_join("pages", "\n"), "needs_ocr": F.col("needs_ocr") & ~use}).drop("native", "ocr_pages")


def preflight(docs: DataFrame, pages: str = "pages") -> DataFrame:
    first = F.char_length(F.coalesce(F.get(F.col(pages), F.lit(0)), F.lit("")))
    chars = F.aggregate(F.col(pages), F.lit(0), lambda a, p: a + F.char_length(p))
    n = F.size(pages)
    return docs.withColumns({"needs_ocr": (n > 0) & ((first < 20) | (chars < 20)), "sparse_text": (n > 0) & ((first < 20) | (chars < 80 * n))})


def read_pdf_layout(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells and words from binary files, by the same library; files that it can't read have none (read_pdf_text tells why)."""

    def rows(batches: Iterator[pd.DataFrame], what: str) -> Iterator[pd.DataFrame]:
        import io

        names = [c.split(" ")[0] for c in (CELLS if what == "cells" else WORDS).split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    import pdfplumber

                    with pdfplumber.open(io.BytesIO(r.content)) as pdf:
                        for n, page in enumerate(pdf.pages, 1):
                            if what == "cells":
                                out += [(r.source_file, n, t, k, row) for t, table in enumerate(page.extract_tables(), 1) for k, row in enumerate(table, 1)]
                            else:
                                out += [(r.source_file, n, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w.get("upright", True)) for w in page.extract_words()]
                except Exception:  # its error row is read_pdf_text's
                    continue
            yield pd.DataFrame(out, columns=names)

    source = files.select("source_file", "content")
    return source.mapInPandas(lambda b: rows(b, "cells"), CELLS), source.mapInPandas(lambda b: rows(b, "words"), WORDS)


def read_pdf_text(files: DataFrame) -> DataFrame:
    """pages from binary files, by a PDF library if the executors have one; else, and where it fails, an error column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    import pdfplumber

                    with pdfplumber.open(io.BytesIO(r.content)) as pdf:
                        out += [(r.source_file, i, p.extract_text() or "", None) for i, p in enumerate(pdf.pages, 1)]
                except Exception as e:  # a file that can't be read is a row of the errors table
                    out.append((r.source_file, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["source_file", "page_no", "text", "error"])

    return files.select("source_file", "content").mapInPandas(run, "source_file string, page_no int, text string, error string")


def unread(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest (path, length, modificationTime, version) doesn't have as they are now."""
    keys = ["path", "length", "modificationTime"]
    return files.join(manifest.select(*keys).distinct(), keys, "left_anti")


def read_manifest(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """What earlier runs read; empty if there is none yet, or if it is of another version."""
    schema = "path string, length long, modificationTime timestamp, version int"
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("version") == version)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def append_manifest(files: DataFrame, path: str, version: int = 1) -> None:
    files.select("path", "length", "modificationTime", F.lit(version).alias("version")).write.mode("append").parquet(path)


def flattened(cells: DataFrame) -> DataFrame:
    """All cells of a document as one text."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "table_no", "row_no", "cells")))
    return cells.groupBy("source_file").agg(F.array_join(F.flatten(F.transform(rows, lambda r: F.array_compact(r["cells"]))), " ").alias("text"))


def guarded(read, empty: DataFrame) -> DataFrame:
    """What read() gives, or an empty frame if its source isn't there."""
    try:
        return read()
    except AnalysisException:
        return empty
