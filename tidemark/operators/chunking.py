"""Overlapping text chunks of the pages of sources, with page and section."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators.segments import running_last, running_number, streamed
from tidemark.sources.shared import bounded_batches

CHUNK_CHARS, OVERLAP_CHARS = 800, 120


def paragraphs(page_text: Column) -> Column:
    """Array of (text, heading) of the paragraphs of a page; blank ones are left out."""
    parts = F.filter(F.split(tx.normalize_whitespace(page_text), "\n\n"), lambda p: tx.trim_space(p) != "")
    return F.transform(parts, lambda p: F.struct(p.alias("text"), tx.detect_heading(p).alias("heading")))


def packer(keys: list[str], each: bool, size: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages (keys, page, parts) in order, parts being (text, heading) each, to chunks (keys, section, page, chunk_index,
    open), where open is the text of the chunk with its outer white space.

    The open buffer, the last heading and the next index are all that is carried on, over the
    pages of a source of any length. A chunk closes before the paragraph that would pass the
    size, and the next one begins with its last characters; a page closes its chunk. Sections
    and indices go on over all pages of a source, or over one row if each row is a source. A
    heading that closes a chunk already labels it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, section, index = None, None, 0
        for batch in batches:
            owners = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            pages, rows, out = batch.column("page").to_pylist(), [], []
            parts = batch.column("parts")
            ends, every = parts.offsets.to_pylist(), parts.values
            texts, headings = every.field("text"), every.field("heading")
            for i, (first, end) in enumerate(zip(ends, ends[1:])):
                if each or owner is None or owners[i] != owner[0]:
                    owner, section, index = (owners[i],), None, 0
                open_ = ""
                for paragraph, heading in zip(texts[first:end].to_pylist(), headings[first:end].to_pylist(), strict=True):
                    section = heading or section
                    if len(open_) + 2 + len(paragraph) > size:
                        if open_.strip(tx.SPACE):
                            rows.append(i)
                            out.append((section, pages[i], index, open_))
                            index += 1
                        open_ = open_[max(0, len(open_) - overlap) :]
                    open_ = f"{open_}\n\n{paragraph}" if open_ else paragraph
                if open_.strip(tx.SPACE):
                    rows.append(i)
                    out.append((section, pages[i], index, open_))
                    index += 1
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                new = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
                old = [batch.column(k).take(pa.array(rows)) for k in keys]
                yield pa.RecordBatch.from_arrays([*old, *new], [*keys, "section", "page", "chunk_index", "open"])

    return run


def chunk_pages(pages: DataFrame, keys: list[str], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks (keys, section, page, chunk_index, content, token_count) of pages
    (keys, page, text): the pages of a source stream through one task in their order, which
    holds one page at a time."""
    ordered = streamed(pages.select(*keys, F.col("page").cast("int").alias("page"), "text"), keys, "page", "text")
    return _chunks(ordered, keys, False, size, overlap)


def chunk_documents(docs: DataFrame, keys: list[str], size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """chunk_pages of sources that have one page (keys, text), a source a row: no shuffle."""
    return _chunks(docs.select(*keys, F.lit(1).alias("page"), "text"), keys, True, size, overlap)


def _chunks(rows: DataFrame, keys: list[str], each: bool, size: int, overlap: int) -> DataFrame:
    bounded_batches(rows.sparkSession)
    split = rows.select(*keys, "page", paragraphs(F.coalesce("text", F.lit(""))).alias("parts"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "section string, page int, chunk_index int, open string"])
    packed = split.mapInArrow(packer(keys, each, size, overlap), schema)
    content, tokens = tx.trim_space(F.col("open")), tx.estimate_tokens(F.col("open"))
    return packed.select(*keys, "section", "page", "chunk_index", content.alias("content"), tokens.alias("token_count"))


def current_section(paras: DataFrame, source: str = "source_id") -> DataFrame:
    """Each paragraph (source, page, para, heading) with the last heading up to it. A source of
    any size spreads over the tasks."""
    return running_last(paras, [source], ["page", "para"], "heading", "section")


def chunk_index(parts: DataFrame, source: str = "source_id") -> DataFrame:
    """0-based index of parts (source, page, seq) over all pages of a source of any size."""
    numbered = running_number(parts, [source], ["page", "seq"], "chunk_index")
    return numbered.withColumn("chunk_index", F.col("chunk_index") - 1)
