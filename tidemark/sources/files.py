"""Stored files: read whole, checked, and turned into pages of text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, file_extension, strip_markup
from tidemark.operators.filters import MOST_BYTES, MOST_ZIP_BYTES, ZIP_EXTENSIONS

CELL_JOINER = " | "
# ---- fixed values of the rule by which the reference's csv library guesses a delimiter:
# ---- what may part cells, rows that are looked at, and the mean number of cells to pass
DELIMITERS, PREVIEW_ROWS, LEAST_CELLS = (",", "\t", "|", ";", "\x1e", "\x1f"), 10, 1.99
# ---- end of fixed values
_SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml")


def read_files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, organization_id, category, length, content) of <org>/<category>/<id>.bin. Of
    files above the size the content is null and is never read; upload_problem names them.
    Files of length 0 are not among Spark's files."""
    return parted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), most_bytes)


def parted(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """read_files of the rows of Spark's reader of binary files."""
    part = lambda n: F.regexp_extract("path", r"([^/]+)/(documents|experiences)/[^/]+$", n)
    named = lambda df, content: df.select("path", part(1).alias("organization_id"), part(2).alias("category"), "length", content)
    fits = F.col("length") <= most_bytes
    return named(files.filter(fits), F.col("content")).unionByName(named(files.filter(~fits), F.lit(None).cast("binary").alias("content")))


def plain_text_pages(files: DataFrame) -> DataFrame:
    """(source_id, page, text) of text files: one page, decoded as UTF-8. Files whose content
    is null have no page; so it is for the other kinds."""
    return files.filter("content IS NOT NULL").select("source_id", F.lit(1).alias("page"), F.decode("content", "UTF-8").alias("text"))


def _pages(read):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if pages := read(row):
                    yield pd.DataFrame({"source_id": [row.source_id] * len(pages), "page": range(1, len(pages) + 1), "text": pages})

    return run


def guess_delimiter(text: str) -> str:
    """The delimiter under which the first rows have the steadiest number of cells, two or
    more on average; of several the one with the most cells; a comma if there is none."""
    best, found = None, ","
    for delimiter in DELIMITERS:
        sizes = [len(cells) for _, cells in zip(range(PREVIEW_ROWS), csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)) if cells]
        if not sizes or sum(sizes) / len(sizes) <= LEAST_CELLS:
            continue
        rank = (sum(abs(a - b) for a, b in zip(sizes, sizes[1:])), -sum(sizes) / len(sizes))
        if best is None or rank < best:
            best, found = rank, delimiter
    return found


def _csv_text(row) -> list[str]:
    """The rows of a file; a file that is no table is one page of plain text."""
    csv.field_size_limit(1 << 62)
    text = bytes(row.content).decode("utf-8", "replace").strip(SPACE)
    try:
        rows = csv.reader(io.StringIO(text, newline=""), delimiter=guess_delimiter(text))
        return ["\n".join(map(CELL_JOINER.join, rows))]
    except csv.Error:
        return [text]


def csv_pages(files: DataFrame) -> DataFrame:
    """One page a file: cells joined by bars, rows by newlines; ragged rows and quoted
    newlines are kept. The delimiter is guessed from the first rows."""
    return files.filter("content IS NOT NULL").select("source_id", "content").mapInPandas(_pages(_csv_text), "source_id string, page int, text string")


def _office_parts(row) -> list[str]:
    """Texts of an archive's pages; an archive that is damaged anywhere in them has none."""
    try:
        return _parts_of(zipfile.ZipFile(io.BytesIO(bytes(row.content))), row)
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
        return []


def _parts_of(archive: zipfile.ZipFile, row) -> list[str]:
    with archive:
        if row.extension == "odt":
            names = ["content.xml"] if "content.xml" in archive.namelist() else []
            return [archive.read(n).decode("utf-8", "replace") for n in names] or [""]
        slides = {int(m[1]): m[0] for m in map(_SLIDE.fullmatch, archive.namelist()) if m}
        return [archive.read(slides[n]).decode("utf-8", "replace") for n in sorted(slides)]


def office_pages(files: DataFrame) -> DataFrame:
    """Pages of pptx files, a slide each in the order of their numbers, and of odt files,
    one page. Files (source_id, file_name, content); markup is stripped by Spark."""
    rows = files.filter("content IS NOT NULL").select("source_id", file_extension(F.col("file_name")).alias("extension"), "content")
    xml = rows.mapInPandas(_pages(_office_parts), "source_id string, page int, text string")
    return xml.withColumn("text", strip_markup(F.col("text")))


#: Kinds of files whose text is read here, and those of them that have pages to count.
PLAIN, TABLES, OFFICE, PAGED = ("txt", "md"), ("csv",), ("pptx", "odt"), ("pptx",)


def _any_parts(row) -> list[str]:
    if row.extension in PLAIN:
        return [bytes(row.content).decode("utf-8", "replace")]
    return _csv_text(row) if row.extension in TABLES else _office_parts(row)


def file_pages(files: DataFrame) -> DataFrame:
    """(source_id, page, text) of files (source_id, file_name, content) of all kinds that are
    read here, each read once; others, and those whose content is null, have no page."""
    rows = files.select("source_id", file_extension(F.col("file_name")).alias("extension"), "content")
    rows = rows.filter(F.col("content").isNotNull() & F.col("extension").isin(*PLAIN, *TABLES, *OFFICE))
    kind = dict(rows.dtypes)["source_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                if pages := _any_parts(row):
                    n = len(pages)
                    yield pd.DataFrame({"source_id": [row.source_id] * n, "page": range(1, n + 1), "text": pages, "markup": [row.extension in OFFICE] * n})

    pages = rows.mapInPandas(run, f"source_id {kind}, page int, text string, markup boolean")
    return pages.withColumn("text", F.when(F.col("markup"), strip_markup(F.col("text"))).otherwise(F.col("text"))).drop("markup")


def _zip_stats(content: bytes) -> tuple[bool, int, int, int]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entries = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return False, 0, 0, 0
    unsafe_at = over_at = len(entries)
    total = 0
    for n, entry in enumerate(entries):
        name = entry.orig_filename
        if unsafe_at == len(entries) and (".." in name or name.startswith("/") or re.match(r"[A-Za-z]:\\", name)):
            unsafe_at = n
        total += entry.file_size
        if over_at == len(entries) and total > MOST_ZIP_BYTES:
            over_at = n + 1 if unsafe_at == n else n
    return True, len(entries), unsafe_at, over_at


def zip_stats(files: DataFrame) -> DataFrame:
    """files with stats (readable, entries, unsafe_at, over_at) of zip containers: the
    first entry with an unsafe path, and the first that passes the unpacked size (the
    number of entries if none). Other files, and those without content, have null stats."""
    kind = "struct<readable:boolean,entries:int,unsafe_at:int,over_at:int>"

    @F.pandas_udf(kind)
    def look(contents: pd.Series) -> pd.DataFrame:
        rows = [_zip_stats(bytes(c)) for c in contents]
        return pd.DataFrame(rows, columns=["readable", "entries", "unsafe_at", "over_at"])

    is_zip = file_extension(F.col("file_name")).isin(*ZIP_EXTENSIONS) & F.col("content").isNotNull()
    return files.withColumn("stats", F.when(is_zip, look(F.coalesce("content", F.lit("").cast("binary")))))
