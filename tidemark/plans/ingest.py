"""Ingest end to end: stored files and lessons in, chunks of the index and outcomes out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import access, chunking, filters, index
from tidemark.sources import files
from tidemark.sources.buckets import BucketedTable
from tidemark.sources.shared import bounded_batches, save
from tidemark.streaming.state import FirstUpload, keep_state

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: The stored index: a source's chunks lie in one bucket, found by a hash of the source.
INDEX_KEYS = ["source_type", "source_id"]
INDEX_SCHEMA = (
    "source_type string, source_id string, organization_id string, source_title string, section string, page int,"
    " chunk_index int, content string, token_count int, chunk_id string, embedding array<float>"
)
_SEEN = "id string, organization_id string, path string, file_name string, length long, sha256 string, problem string"
_OUTCOME = ["id", "organization_id", "sha256", "status", "reason", "existing_id", "page_count", "chunk_count"]


def named_files(found: DataFrame) -> DataFrame:
    """Files of sources.files.read_files with id and file_name, both the last part of the path."""
    name = F.element_at(F.split("path", "/"), -1)
    return found.withColumns({"file_name": name, "id": F.concat_ws("/", "organization_id", name)})


def with_vectors(chunks: DataFrame, dimensions: int = vx.DIMENSIONS) -> DataFrame:
    """chunks with source_type, chunk_id and embedding."""
    tokens = tx.tokenize(F.col("content"))
    number = F.concat_ws("#", "source_type", F.col("source_id").cast("string"), F.col("chunk_index").cast("string"))
    return chunks.withColumns({"chunk_id": number, "embedding": vx.hash_embedding(tokens, dimensions)})


def looked_at(uploads: DataFrame) -> DataFrame:
    """uploads (file_name, length, content, ...) without their contents, but with the hash of
    it and the first rule that is broken, of names and sizes, then of archives."""
    problem = F.coalesce(filters.upload_problem(F.col("file_name"), F.col("length")), filters.zip_problem(F.col("stats")))
    return files.zip_stats(uploads).withColumns({"problem": problem, "sha256": F.sha2("content", 256)}).drop("stats", "content")


def _indexed(seen: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes and chunks of what was seen (id, organization_id, file_name, sha256, problem,
    existing_id), from the contents (id, file_name, content) of the fresh ones."""
    pages = save(files.file_pages(contents.select(F.col("id").alias("source_id"), "file_name", "content")), "pages")
    owners = seen.select(F.col("id").alias("source_id"), "organization_id", F.col("file_name").alias("source_title"))
    cut = save(chunking.chunk_pages(pages, ["source_id"]), "chunks")
    chunks = with_vectors(cut.join(owners, "source_id").withColumn("source_type", F.lit("document")))
    fresh = seen.filter("problem IS NULL AND existing_id IS NULL")
    counts = access.ingest_summary(fresh, pages, cut).select("id", "page_count", "chunk_count", F.col("status").alias("read"))
    # kinds that have no pages to count leave the number open, whether they gave text or not
    unpaged = tx.file_extension(F.col("file_name")).isin(*files.PLAIN, *files.TABLES, *(k for k in files.OFFICE if k not in files.PAGED))
    status = F.when(F.col("problem").isNotNull(), "rejected").when(F.col("existing_id").isNotNull(), "duplicate").otherwise(F.col("read"))
    outcomes = seen.join(counts, "id", "left").withColumns(
        {"status": status, "reason": F.col("problem"), "page_count": F.when(~unpaged, F.col("page_count"))}
    )
    return outcomes.select(*_OUTCOME), chunks


def ingest_files(uploads: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes and chunks of uploads (id, organization_id, file_name, length, content).

    An upload is rejected by the first rule that it breaks; is a duplicate if a stored document
    (id, organization_id, sha256, deleted_at) or an earlier upload has its content, and is not
    itself; else its pages are read, cut and indexed. Outcomes: id, organization_id, sha256,
    status (rejected, duplicate, completed, failed), reason, existing_id, page_count (null for
    kinds of files without pages), chunk_count.

    Contents are read twice: once for what is decided without their text, once, of what is
    fresh, for their text; hashes, pages and chunks are stored and read from there. Contents
    are never shuffled, but to drop duplicates, where these are too many for a broadcast.
    """
    bounded_batches(uploads.sparkSession)
    slim = save(looked_at(uploads), "uploads")
    known = index.duplicate_uploads(slim.filter("problem IS NULL").select("id", "organization_id", "sha256"), stored)
    seen = save(slim.join(known.select("id", "existing_id"), "id", "left"), "seen")
    settled = seen.filter("problem IS NOT NULL OR existing_id IS NOT NULL").select("id")
    return _indexed(seen, uploads.join(settled, "id", "left_anti"))


def ingest_lessons(lessons: DataFrame) -> DataFrame:
    """Chunks of lessons (id, organization_id, title, the fields of their text, tags)."""
    fields = {name: F.col(name) for name in tx.EXPERIENCE_LABELS if name in lessons.columns}
    text = tx.experience_text(fields, F.coalesce("tags", F.array().cast("array<string>")))
    docs = lessons.select(F.col("id").alias("source_id"), "organization_id", F.col("title").alias("source_title"), text.alias("text"))
    cut = chunking.chunk_documents(docs, ["source_id", "organization_id", "source_title"])
    return with_vectors(cut.withColumn("source_type", F.lit("experience")))


def stored_index(spark: SparkSession, target: str, buckets: int = 256) -> BucketedTable:
    return BucketedTable(spark, f"{target}/index", INDEX_KEYS, INDEX_SCHEMA, buckets)


def first_uploads(seen: DataFrame, stored: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """A stream of uploads (id, organization_id, path, file_name, length, sha256, problem) with
    existing_id: the upload that holds the content, over all micro-batches, beginning with what
    is stored (id, organization_id, sha256, deleted_at). A stream of deleted documents (id,
    organization_id, sha256) frees their contents. Uploads with a problem hold nothing.

    State: an id for each content of an organisation. The rows of one content in a micro-batch,
    without the content, meet in one task; the source's limits bound them.
    """
    keep_state(seen.sparkSession)
    columns = [c.split()[0] for c in _SEEN.split(", ")]
    rows = seen.select(*(F.col(c) for c in columns), F.lit(False).alias("deleted"))
    if deleted is not None:
        blank = {c: F.lit(None).cast(k) for c, k in (f.split() for f in _SEEN.split(", "))}
        gone = deleted.select(*((F.col(c).cast("string") if c in ("id", "organization_id", "sha256") else blank[c]).alias(c) for c in columns), F.lit(True).alias("deleted"))
        rows = rows.unionByName(gone)
    live = stored.filter("deleted_at IS NULL").select(F.col("organization_id").cast("string"), "sha256", F.col("id").cast("string"))
    first = live.groupBy("organization_id", "sha256").agg(F.min("id").alias("id")).groupBy("organization_id", "sha256")
    return rows.groupBy("organization_id", "sha256").transformWithStateInPandas(
        FirstUpload(), f"{_SEEN}, existing_id string", "append", "None", initialState=first
    )


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files at these paths, whose characters stand for themselves."""
    if not paths:
        return spark.createDataFrame([], FILE_SCHEMA)
    return spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths])


def index_batch(spark: SparkSession, seen: DataFrame, target: str, number: int, buckets: int = 256) -> None:
    """Write the outcomes of micro-batch number (of first_uploads) to target/outcomes/batch=n
    and the chunks of its fresh files into the stored index. May run again: what a batch has
    written it writes over, and a batch that is in the index is not put there again."""
    path = f"{target}/uploads/batch={number}"
    seen.write.mode("overwrite").parquet(path)  # the state's answer, asked once
    seen = spark.read.schema(f"{_SEEN}, existing_id string").parquet(path)
    fresh = seen.filter("problem IS NULL AND existing_id IS NULL")
    paths = [r.path for r in fresh.select("path").collect()]  # at most the files of a micro-batch
    outcomes, chunks = _indexed(seen, named_files(files.parted(_contents(spark, paths))))
    gone = fresh.select(F.lit("document").alias("source_type"), F.col("id").alias("source_id"))
    stored_index(spark, target, buckets).replace(chunks, gone, stamp=number)
    outcomes.write.mode("overwrite").parquet(f"{target}/outcomes/batch={number}")


def stream_files(spark: SparkSession, root: str, checkpoint: str, stored: DataFrame, target: str, files_at_once: int = 1000, deleted: DataFrame | None = None, buckets: int = 256):
    """Start a job over the files that arrive under root: each is looked at, decided by the
    state of first_uploads, and indexed under target (see index_batch and stored_index)."""
    options = {"recursiveFileLookup": "true", "maxFilesPerTrigger": files_at_once}
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).options(**options).load(root)
    seen = first_uploads(looked_at(named_files(files.parted(found))), stored, deleted)
    write = lambda batch, number: index_batch(batch.sparkSession, batch, target, number, buckets)
    return seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
