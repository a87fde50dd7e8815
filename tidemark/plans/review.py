"""Review workflows to their end: statuses, audit events, and what the index holds after."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import workflow
from tidemark.plans import ingest
from tidemark.sources import tables
from tidemark.sources.buckets import BucketedTable
from tidemark.sources.shared import save

# ---- fixed values: codes of audit events, by the status or the action that was accepted
KNOWLEDGE_EVENTS = {
    "UNDER_REVIEW": "KNOWLEDGE_SUBMIT",
    "APPROVED": "KNOWLEDGE_APPROVE",
    "PUBLISHED": "KNOWLEDGE_PUBLISH",
    "DRAFT": "KNOWLEDGE_REJECT",
    "ARCHIVED": "KNOWLEDGE_ARCHIVE",
}
EXPERIENCE_EVENTS = {
    "submit": "EXPERIENCE_SUBMIT",
    "approve": "EXPERIENCE_APPROVE",
    "reject": "EXPERIENCE_REJECT",
    "publish": "EXPERIENCE_PUBLISH",
    "archive": "EXPERIENCE_ARCHIVE",
}
# ---- end of fixed values


def _code(codes: dict[str, str], column: str):
    return F.element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), F.col(column))


def knowledge_events(steps: DataFrame) -> DataFrame:
    """(resource_type, resource_id, seq, event_code, metadata) of the accepted steps of
    workflow.knowledge_transitions, with the statuses before and after each."""
    before = Window.partitionBy("item_id").orderBy("seq", "target")
    steps = steps.withColumn("previous", F.coalesce(F.lag("status").over(before), F.lit("DRAFT")))
    said = F.to_json(F.struct(F.col("previous").alias("previousStatus"), F.col("status").alias("newStatus")))
    return steps.filter("accepted").select(
        F.lit("knowledge").alias("resource_type"), F.col("item_id").alias("resource_id"), "seq", _code(KNOWLEDGE_EVENTS, "target").alias("event_code"), said.alias("metadata")
    )


def experience_events(requests: DataFrame, lessons: DataFrame) -> DataFrame:
    """The same of actions on lessons (id, status), each of which is accepted where it is
    permitted; with the notes that came with it."""
    rows = requests.filter(F.coalesce("permitted", F.lit(True))) if "permitted" in requests.columns else requests
    rows = rows.filter(F.col("action").isin(*EXPERIENCE_EVENTS)).withColumn("status", _code(workflow.ACTIONS, "action"))
    before = Window.partitionBy("item_id").orderBy("seq")
    rows = rows.withColumn("lagged", F.lag("status").over(before)).join(lessons.select(F.col("id").alias("item_id"), F.col("status").alias("own")), "item_id")
    said = F.to_json(F.struct(F.coalesce("lagged", "own").alias("previousStatus"), F.col("status").alias("newStatus"), F.col("notes").alias("notes")))
    return rows.select(
        F.lit("experience").alias("resource_type"), F.col("item_id").alias("resource_id"), "seq", _code(EXPERIENCE_EVENTS, "action").alias("event_code"), said.alias("metadata")
    )


def apply_knowledge(requests: DataFrame, index: BucketedTable, audit: str, batch: int) -> DataFrame:
    """Replay a batch of requests (see workflow.knowledge_transitions) from drafts on: chunks of
    articles that end archived leave the index, and each accepted request is an audit event.
    Returns the steps, stored. May run again: the index and the events of a batch are replaced."""
    steps = save(workflow.knowledge_transitions(requests), "steps")
    gone = steps.filter("accepted AND target = 'ARCHIVED'").select(F.lit("knowledge").alias("source_type"), F.col("item_id").cast("string").alias("source_id"))
    index.replace(index.read().limit(0), gone)
    tables.write_events(knowledge_events(steps), audit, batch)
    return steps


def apply_lessons(lessons: DataFrame, requests: DataFrame, index: BucketedTable, audit: str, batch: int) -> DataFrame:
    """Replay a batch of actions (see workflow.experience_transitions) on lessons (see
    ingest.ingest_lessons; status): those that end published are cut and indexed anew, all
    others that were acted on leave the index, and each accepted action is an audit event.
    Returns the new statuses and stamps, stored. May run again, as apply_knowledge."""
    ended = save(workflow.experience_transitions(requests), "ended")
    acted = lessons.drop("status").join(ended.select(F.col("item_id").alias("id"), "status"), "id")
    columns = [f.name for f in index.read().schema.fields]
    fresh = ingest.ingest_lessons(acted.filter("status = 'PUBLISHED'")).withColumn("source_id", F.col("source_id").cast("string"))
    gone = acted.select(F.lit("experience").alias("source_type"), F.col("id").cast("string").alias("source_id"))
    index.replace(fresh.select(*columns), gone)
    tables.write_events(experience_events(requests, lessons), audit, batch)
    return ended
