"""Bucketed tables, segmented scans and the ordered fold of pages."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import access, chunking, segments
from tidemark.sources import files
from tidemark.sources.buckets import BucketedTable
from tidemark.streaming import replay

SCHEMA = "source_type string, source_id long, content string, version int"


def files_under(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def sources(spark, ids, version=1, chunks=2):
    rows = spark.createDataFrame([(i,) for i in ids], "source_id long").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(chunks))))
    content = F.concat(F.lit("chunk "), F.col("k"), F.lit(" of "), F.col("source_id"))
    return rows.select(F.lit("document").alias("source_type"), "source_id", content.alias("content"), F.lit(version).alias("version"))


def test_one_source_of_many_is_replaced_in_its_bucket(spark, tmp_path):
    """Of 10^4 sources one gets new chunks, one loses all: the files of other buckets stay."""
    table = BucketedTable(spark, str(tmp_path / "index"), ["source_type", "source_id"], SCHEMA, 32)
    assert table.read().count() == 0
    assert len(table.replace(sources(spark, range(10_000)))) == 32
    before = files_under(tmp_path / "index" / "data")
    touched = table.replace(sources(spark, [77], 2, 3), sources(spark, [77, 78], 2))
    after = files_under(tmp_path / "index" / "data")
    assert 1 <= len(touched) <= 2 and set(before.items()) <= set(after.items())
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in set(after) - set(before)} <= set(touched)
    got = table.read().filter("source_id IN (77, 78)")
    assert rows_of(got.select("source_id", "version")) == [(77, 2)] * 3 and table.read().count() == 2 * 9998 + 3
    table.vacuum()
    kept = files_under(tmp_path / "index" / "data")
    assert {p for p in before if int(p.split("bucket=")[1].split("/")[0]) not in touched} <= set(kept) < set(after)
    assert table.read().count() == 2 * 9998 + 3
    with pytest.raises(ValueError, match="buckets"):
        BucketedTable(spark, str(tmp_path / "index"), ["source_type", "source_id"], SCHEMA, 8).read()


def test_changes_by_key(spark, tmp_path):
    """Absent keys are added, the newest row of a key stays; done again, a change changes
    nothing; a stamp that was there is left out; a null is a key."""
    table = BucketedTable(spark, str(tmp_path / "settings"), ["name"], "name string, value string, at int", 4)
    rows = lambda *r: spark.createDataFrame(list(r), "name string, value string, at int")
    for _ in range(2):
        table.insert_if_absent(rows(("a", "1", 1), ("a", "0", 0), (None, "n", 1), ("b", "1", 1)), ["at"])
        assert rows_of(table.read()) == [("a", "0", 0), ("b", "1", 1), (None, "n", 1)]
    for _ in range(2):
        table.upsert(rows(("a", "5", 5), ("b", "old", 0), ("c", "2", 2), (None, "m", 2)), ["at", "value"])
        assert rows_of(table.read()) == [("a", "5", 5), ("b", "1", 1), ("c", "2", 2), (None, "m", 2)]
    assert table.replace(rows(("a", "7", 7)), stamp=3) and not table.replace(rows(("a", "8", 8)), stamp=3)
    assert table.replace(rows(), rows((None, None, None), ("b", None, None)), stamp=4)
    assert rows_of(table.read()) == [("a", "7", 7), ("c", "2", 2)]


def test_a_change_that_fails_is_not_read(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), ["source_id"], SCHEMA, 2)
    table.replace(sources(spark, range(10)))
    want = rows_of(table.read())
    bad = sources(spark, range(10), 2).withColumn("content", F.when(F.col("source_id") < 9, F.col("content")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert rows_of(table.read()) == want
    table.replace(sources(spark, range(10), 2))
    assert {r.version for r in table.read().collect()} == {2}


HOT = [(7 if i % 2 else i % 9, i // 3, i, "h%d" % i if i % 10 == 3 else None) for i in range(4000)] + [(None, 1, 1, "x"), (None, 1, 1, None), (None, 2, 0, None)]


def test_hot_keys_spread(spark):
    """A key with half of all rows, and a null one: values as of a window, in many pieces."""
    from pyspark.sql import Window

    df = spark.createDataFrame(HOT, "k int, a int, b int, v string")
    w = Window.partitionBy("k").orderBy("a", "b")
    numbered = segments.running_number(df, ["k"], ["a", "b"], "n")
    assert rows_of(numbered.filter("k IS NOT NULL")) == rows_of(df.withColumn("n", F.row_number().over(w)).filter("k IS NOT NULL"))
    assert sorted(r.n for r in numbered.filter("k IS NULL").collect()) == [1, 2, 3]
    last = segments.running_last(df.filter("k IS NOT NULL"), ["k"], ["a", "b"], "v", "s")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    assert rows_of(last) == rows_of(df.filter("k IS NOT NULL").withColumn("s", F.last("v", ignorenulls=True).over(rows)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would make one partition
    try:
        pieces = segments._pieces(df, ["k"], ["a", "b"]).filter("k = 7").groupBy("segment piece").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces) >= 2 and max(r["count"] for r in pieces) <= 1600  # of 2,000, in 4 partitions
    assert segments.running_number(df.limit(0), ["k"], ["a"], "n").count() == 0


def test_backlog_of_one_tenant(spark):
    jobs = spark.range(3000).select("id", F.lit("t").alias("organization_id"), F.lit("PENDING").alias("status"), F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"), (F.col("id") % 50).alias("created_at"))
    got = {r.id: r.place for r in access.pending_backlog(jobs).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(3000), key=lambda i: (i % 50, i)) and sorted(got.values()) == list(range(1, 3001))


def plain_chunks(pages, size, overlap):
    """The rule, page by page, with everything in memory."""
    chunks, section = [], None
    for number, paragraphs in pages:
        open_ = ""
        for text, heading in paragraphs:
            section = heading or section
            if len(open_ + "\n\n" + text) > size:
                if open_.strip():
                    chunks.append((section, number, len(chunks), open_.strip(), -(-len(open_) // 3)))
                tail = open_[-overlap:] if open_ else ""
                open_ = f"{tail}\n\n{text}" if tail else text
            else:
                open_ = f"{open_}\n\n{text}" if open_ else text
        if open_.strip():
            chunks.append((section, number, len(chunks), open_.strip(), -(-len(open_) // 3)))
    return chunks


def test_a_source_of_many_pages_streams(spark):
    """10^5 pages of one source, and a small one, in the order of their pages."""
    n = 100_000
    text = F.concat(F.when(F.col("id") % 1000 == 5, F.concat(F.lit("# Part "), F.col("id"), F.lit("\n\n"))).otherwise(F.lit("")), F.lit("page "), F.col("id"), F.lit(" has words\n\nand more of them"))
    pages = spark.range(n).select(F.lit(1).alias("source_id"), F.col("id").cast("int").alias("page"), text.alias("text"))
    pages = pages.unionByName(spark.createDataFrame([(2, 2, "b"), (2, 1, "# A\n\na")], "source_id int, page int, text string")).repartition(7)
    got = chunking.chunk_pages(pages, ["source_id"], 30, 8)
    made = [(i, ([(f"# Part {i}", f"Part {i}")] if i % 1000 == 5 else []) + [(f"page {i} has words", None), ("and more of them", None)]) for i in range(n)]
    want = plain_chunks(made, 30, 8)
    rows = got.filter("source_id = 1").orderBy("chunk_index").select("section", "page", "chunk_index", "content", "token_count").collect()
    assert list(map(tuple, rows)) == want
    assert rows_of(got.filter("source_id = 2").select("section", "page", "chunk_index", "content")) == [("A", 1, 0, "# A\n\na"), ("A", 2, 1, "b")]


def test_the_fold_holds_one_page(spark):
    """Batches are taken one at a time, and what is carried over does not grow with them."""
    taken = []

    def batches():
        for i in range(2000):
            taken.append(i)
            parts = pa.array([[{"text": "t" * 50, "heading": None}] * 20], pa.list_(pa.struct([("text", pa.string()), ("heading", pa.string())])))
            yield pa.RecordBatch.from_pydict({"s": [1], "page": pa.array([i], pa.int32()), "parts": parts})

    made = chunking.packer(["s"], False, 100, 10)(batches())
    first = next(made)
    assert len(taken) == 1 and first.num_rows == 20
    last = [b.column("chunk_index")[-1].as_py() for b in made][-1]
    assert len(taken) == 2000 and last == 2000 * 20 - 1


def test_white_space_of_the_reference(spark):
    """The byte order mark is white space at the ends and in runs, U+0085 is none."""
    rows = [("﻿# Title\n\nBody﻿",), ("\x85# no heading",), ("1.﻿One",), ("a﻿ 　b\x85c",)]
    df = spark.createDataFrame(rows, "t string").select("t", tx.normalize_whitespace(F.col("t")).alias("n"), tx.detect_heading(F.col("t")).alias("h"), tx.collapse(F.col("t")).alias("c"))
    got = {r.t: (r.n, r.h, r.c) for r in df.collect()}
    assert got["﻿# Title\n\nBody﻿"][0] == "# Title\n\nBody"
    assert got["\x85# no heading"][:2] == ("\x85# no heading", None)
    assert got["1.﻿One"][1] == "1.﻿One" and got["a﻿ 　b\x85c"][2] == "a b\x85c"
    docs = spark.createDataFrame([("d", "﻿# Title\n\nBody")], "source_id string, text string")
    assert [(r.section, r.content) for r in chunking.chunk_documents(docs, ["source_id"]).collect()] == [("Title", "# Title\n\nBody")]


def test_files_with_a_byte_order_mark(spark):
    uploads = [("a", "a.csv", b"\xef\xbb\xbfx;y\n1;2\x1f\n"), ("b", "b.txt", b"\xef\xbb\xbfplain \xff"), ("c", "c.pdf", b"x"), ("d", "d.txt", None)]
    df = spark.createDataFrame(uploads, "source_id string, file_name string, content binary")
    want = [("a", 1, "x | y\n1 | 2\x1f"), ("b", 1, "﻿plain �")]
    assert rows_of(files.file_pages(df)) == want
    assert rows_of(files.csv_pages(df.filter("source_id = 'a'"))) == want[:1]


def test_page_count_is_open_for_kinds_without_pages(spark):
    documents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    pages = spark.createDataFrame([(1, 1, False), (2, 1, True), (2, 2, True)], "source_id int, page int, paged boolean")
    got = {r.id: r.page_count for r in access.ingest_summary(documents, pages, spark.createDataFrame([(1,)], "source_id int")).collect()}
    assert got == {1: None, 2: 2, 3: 0}


def test_limits_of_one_key_in_batches(spark):
    """What the streams are compared with: remaining and reset_at of a single key."""
    rows = [("k", "login", f"2024-01-01 00:0{i}:00", i) for i in range(7)]
    df = spark.createDataFrame(rows, "key string, action string, ts string, id int").withColumn("ts", F.to_timestamp("ts"))
    got = replay.sliding_log_limit(df).orderBy("id").collect()
    assert [(r.allowed, r.remaining) for r in got] == [(True, 4), (True, 3), (True, 2), (True, 1), (True, 0), (False, 0), (False, 0)]


def test_a_hot_item_is_replayed_in_pieces(spark):
    """An item with most requests, cut in pieces: statuses, decisions and stamps as of the
    sequential fold, which is that of no hot item."""
    import random

    from tidemark.operators import workflow

    rng = random.Random(4)
    targets = ["UNDER_REVIEW", "APPROVED", "PUBLISHED", "DRAFT", "DRAFT", "UNDER_REVIEW", "ODD", ""]
    rows = [(5 if i % 4 else i % 12, i, rng.choice(targets), rng.randrange(9), i * 10, rng.random() < 0.9) for i in range(3000)]
    rows += [(5, 2999, "ARCHIVED", 1, 7, True), (None, 1, "UNDER_REVIEW", 1, 1, True)] + [(6, i, "ARCHIVED" if i == 100 else "UNDER_REVIEW", 2, i, True) for i in range(400)]
    df = spark.createDataFrame(rows, "item_id int, seq long, target string, user_id int, ts long, permitted boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df_of in (df, df.drop("user_id")):
            want = rows_of(workflow.knowledge_transitions(df_of))
            assert rows_of(workflow.knowledge_transitions(df_of, 300)) == want
        pieces = segments.pieces_of(df.filter("item_id = 5"), ["item_id"], ["seq"], "piece", "at")
        assert pieces.select("piece").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert any(r[3] for r in want) and not all(r[3] for r in want)


def test_streams_stay_whole_above_a_join(spark):
    """A join by the same key whose one side turns out to be small reads the other as it was
    written; the attempts of a user still meet in one task."""
    attempts = spark.range(40_000).select((F.col("id") % 50).alias("user_id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"), "id", F.lit(False).alias("success"))
    users = spark.range(400_000).select((F.col("id") % 50).alias("id"), F.lit(True).alias("is_active")).distinct()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = replay.login_lockout(attempts.repartition(4), users).groupBy("user_id").agg(F.max("failures").alias("n")).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r.user_id: r.n for r in got} == dict.fromkeys(range(50), 800)
