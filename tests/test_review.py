"""Workflows with their index and audit, and databases with uuid keys."""

import json
import uuid

from pyspark.sql import functions as F

from tidemark.plans import ingest, review
from tidemark.sources import tables


def index_of(spark, tmp_path, rows):
    index = ingest.stored_index(spark, str(tmp_path), 4)
    blank = dict.fromkeys([f.split()[0] for f in ingest.INDEX_SCHEMA.split(", ")])
    index.replace(spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], ingest.INDEX_SCHEMA))
    return index


def events_of(spark, path):
    found = spark.read.parquet(path).collect()
    return sorted((r.event_code, str(r.resource_id), json.loads(r.metadata).get("previousStatus"), json.loads(r.metadata)["newStatus"], r.outcome) for r in found)


def test_archived_articles_leave_the_index(spark, tmp_path):
    index = index_of(spark, tmp_path, [{"source_type": t, "source_id": i, "content": "c"} for t in ("knowledge", "document") for i in ("1", "2", "3")])
    requests = spark.createDataFrame([(1, 1, "UNDER_REVIEW", True), (1, 2, "ARCHIVED", True), (2, 1, "ARCHIVED", False), (3, 1, "PUBLISHED", True), (3, 2, "UNDER_REVIEW", True)], "item_id int, seq long, target string, permitted boolean")
    for _ in range(2):  # a batch that runs again leaves the same
        review.apply_knowledge(requests, index, str(tmp_path / "audit"), 5)
        assert sorted((r.source_type, r.source_id) for r in index.read().collect()) == [("document", "1"), ("document", "2"), ("document", "3"), ("knowledge", "2"), ("knowledge", "3")]
        assert events_of(spark, str(tmp_path / "audit")) == [
            ("KNOWLEDGE_ARCHIVE", "1", "UNDER_REVIEW", "ARCHIVED", "SUCCESS"),
            ("KNOWLEDGE_SUBMIT", "1", "DRAFT", "UNDER_REVIEW", "SUCCESS"),
            ("KNOWLEDGE_SUBMIT", "3", "DRAFT", "UNDER_REVIEW", "SUCCESS"),
        ]


def test_published_lessons_are_indexed(spark, tmp_path):
    index = index_of(spark, tmp_path, [{"source_type": "experience", "source_id": i, "content": "old"} for i in ("a", "b", "c")])
    lessons = spark.createDataFrame([(i, "o", "Seals", "It leaks", None, "APPROVED") for i in ("a", "b", "n")], "id string, organization_id string, title string, problem_description string, tags array<string>, status string")
    requests = spark.createDataFrame(
        [("a", 1, "publish", "u", None, True), ("b", 1, "publish", "u", None, True), ("b", 2, "archive", "u", "old", True), ("n", 1, "reject", "u", "no", True), ("n", 2, "publish", "u", None, False)],
        "item_id string, seq long, action string, user_id string, notes string, permitted boolean",
    ).withColumn("ts", F.timestamp_seconds("seq"))
    for _ in range(2):
        ended = review.apply_lessons(lessons, requests, index, str(tmp_path / "audit"), 1)
        assert {r.item_id: r.status for r in ended.collect()} == {"a": "PUBLISHED", "b": "ARCHIVED", "n": "CHANGES_REQUESTED"}
        rows = {r.source_id: r for r in index.read().collect()}
        assert set(rows) == {"a", "c"} and "It leaks" in rows["a"].content and rows["a"].chunk_id == "experience#a#0" and rows["c"].content == "old"
        assert events_of(spark, str(tmp_path / "audit")) == [
            ("EXPERIENCE_ARCHIVE", "b", "PUBLISHED", "ARCHIVED", "SUCCESS"), ("EXPERIENCE_PUBLISH", "a", "APPROVED", "PUBLISHED", "SUCCESS"),
            ("EXPERIENCE_PUBLISH", "b", "APPROVED", "PUBLISHED", "SUCCESS"), ("EXPERIENCE_REJECT", "n", "APPROVED", "CHANGES_REQUESTED", "SUCCESS"),
        ]


DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def test_tables_with_uuid_keys(spark, tmp_path):
    """Ranges hold about as many rows each, and each row once, also with odd keys."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(str(uuid.UUID(int=(i * 0x9E3779B97F4A7C15F39CC0605CEDC835) % (1 << 128))), i) for i in range(1500)]
    odd = [("", -2), ("zzz", -3), ("ffffffff-", -4)]
    spark.createDataFrame(rows + odd, "id string, n int").coalesce(1).write.jdbc(url, "users", properties={"driver": DRIVER, "createTableColumnTypes": "id varchar(40)"})
    got = tables.read_jdbc_by_uuid(spark, url, "users", '"id"', 6, driver=DRIVER)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * min(sizes)
    assert sorted(r.n for r in got.collect()) == sorted([*range(1500), -2, -3, -4])
    assert tables.uuid_ranges("id", 1) == ["1 = 1"] and tables.uuid_ranges("id", 3)[0].endswith("OR id IS NULL")


def test_upsert_into_a_database(spark, tmp_path):
    """New keys are added, known ones updated; done again it leaves the same."""
    url, text = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": DRIVER, "createTableColumnTypes": "key varchar(40), value varchar(40)"}
    spark.createDataFrame([("rag.top_k", "8", 1), ("other", "x", 1)], "key string, value string, at int").write.jdbc(url, "settings", properties=text)
    new = spark.createDataFrame([("rag.top_k", "12", 2), ("rag.min_score", "0.2", 2)], "key string, value string, at int").repartition(2)
    for _ in range(2):
        tables.merge_jdbc(new, url, "settings", ["key"], "settings_staging", **text)
        got = spark.read.jdbc(url, "settings", properties={"driver": DRIVER}).collect()
        assert sorted(map(tuple, got)) == [("other", "x", 1), ("rag.min_score", "0.2", 2), ("rag.top_k", "12", 2)]
