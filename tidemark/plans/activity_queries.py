"""Queries of event logs: limits, lockouts, workflows and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import workflow
from tidemark.plans import review
from tidemark.plans import standins as st
from tidemark.sources import tables
from tidemark.streaming import replay

QUERIES, SQL = {}, {}
AS_OF = f"TIMESTAMP '{st.AS_OF}'"
LIMITS_SQL = "CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 ELSE 2 END"
WINDOW_SQL = "CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 10 ELSE 5 END * 86400000000"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    f"""SELECT user_id AS key, event_type AS action, count(*) AS n, count(*) < max({LIMITS_SQL}) AS allowed, greatest(0, max({LIMITS_SQL}) - count(*) - 1)::BIGINT AS remaining
    FROM events WHERE epoch_us(ts) >= epoch_us({AS_OF}) - {WINDOW_SQL} GROUP BY ALL"""
)
def attempts_in_window(spark, sf_dir):
    return replay.attempts_in_window(st.attempts(spark, sf_dir), F.to_timestamp(F.lit(st.AS_OF)), st.TEST_LIMITS)


@query(
    """SELECT user_id AS key, time_bucket(INTERVAL 12 HOUR, ts) AS window_start, count(*) AS n, count(*) <= 2 AS allowed, greatest(0, 2 - count(*))::BIGINT AS remaining
    FROM events GROUP BY ALL"""
)
def fixed_window_counts(spark, sf_dir):
    return replay.fixed_window_counts(st.attempts(spark, sf_dir), 12 * 3600, 2)


@query(f"SELECT event_id AS id FROM events WHERE ts >= {AS_OF} - INTERVAL 1 HOUR")
def expire_attempts(spark, sf_dir):
    return replay.expire_attempts(st.attempts(spark, sf_dir), F.to_timestamp(F.lit(st.AS_OF))).select("id")


@query(
    f"""WITH RECURSIVE a AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, {LIMITS_SQL} AS most, {WINDOW_SQL} AS span,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    s AS (
      SELECT user_id, event_type, 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS id, true AS allowed, 0::BIGINT AS most, 0::BIGINT AS reset FROM (SELECT DISTINCT user_id, event_type FROM a)
      UNION ALL
      SELECT s.user_id, s.event_type, a.n,
        CASE WHEN len(list_filter(s.kept, lambda x: x >= a.t - a.span)) < a.most THEN list_append(list_filter(s.kept, lambda x: x >= a.t - a.span), a.t) ELSE list_filter(s.kept, lambda x: x >= a.t - a.span) END,
        a.event_id, len(list_filter(s.kept, lambda x: x >= a.t - a.span)) < a.most, a.most, a.t + a.span
      FROM s JOIN a ON a.user_id = s.user_id AND a.event_type = s.event_type AND a.n = s.n + 1)
    SELECT user_id AS key, event_type AS action, id, allowed, CASE WHEN allowed THEN most - len(kept) ELSE 0 END AS remaining, reset // 1000000 AS reset_second
    FROM s WHERE id IS NOT NULL"""
)
def sliding_log_limit(spark, sf_dir):
    found = replay.sliding_log_limit(st.attempts(spark, sf_dir), st.TEST_LIMITS)
    return found.select("key", "action", "id", "allowed", "remaining", F.unix_seconds("reset_at").alias("reset_second"))


@query(
    """WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'purchase' AS good, user_id % 13 <> 0 AS known, user_id % 7 <> 0 AS active,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    o AS (
      SELECT user_id, 0::BIGINT AS n, CASE WHEN user_id % 13 <> 0 THEN user_id % 4 ELSE 0 END AS failures,
        CASE WHEN user_id % 5 = 0 AND user_id % 13 <> 0 THEN epoch_us(TIMESTAMP '2024-01-08 00:00:00') ELSE 0 END AS locked,
        CASE WHEN user_id % 3 = 0 AND user_id % 13 <> 0 THEN epoch_us(TIMESTAMP '2023-12-31 00:00:00') END AS seen,
        NULL::BIGINT AS id, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT user_id FROM a)
      UNION ALL
      SELECT o.user_id, a.n,
        CASE WHEN NOT known OR locked > t OR NOT active THEN failures WHEN good THEN 0 ELSE failures + 1 END,
        CASE WHEN NOT known OR locked > t OR NOT active THEN locked WHEN good THEN 0 WHEN failures + 1 >= 5 THEN t + 900000000 ELSE 0 END,
        CASE WHEN known AND locked <= t AND active AND good THEN t ELSE seen END,
        event_id,
        CASE WHEN NOT known THEN 'user_not_found' WHEN locked > t THEN 'account_locked' WHEN NOT active THEN 'account_inactive' WHEN good THEN 'success' ELSE 'wrong_password' END
      FROM o JOIN a ON a.user_id = o.user_id AND a.n = o.n + 1)
    SELECT user_id, id, outcome, failures, nullif(locked, 0) // 1000000 AS locked_second, seen // 1000000 AS login_second FROM o WHERE id IS NOT NULL"""
)
def login_lockout(spark, sf_dir):
    """Events as logins: purchases succeed, all else fails; some users are unknown, some
    begin with failures, a lock or a login."""
    events = st.table(spark, sf_dir, "events")
    attempts = events.select("user_id", "ts", F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("success"))
    users = events.filter("user_id % 13 <> 0").select(F.col("user_id").alias("id")).distinct()
    at = lambda text: F.to_timestamp(F.lit(text))
    users = users.select(
        "id", (F.col("id") % 7 != 0).alias("is_active"), (F.col("id") % 4).alias("failed_login_attempts"),
        F.when(F.col("id") % 5 == 0, at("2024-01-08 00:00:00")).alias("locked_until"), F.when(F.col("id") % 3 == 0, at("2023-12-31 00:00:00")).alias("last_login"),
    )
    seconds = [F.unix_seconds(c).alias(name) for c, name in (("locked_until", "locked_second"), ("last_login", "login_second"))]
    return replay.login_lockout(attempts, users).select("user_id", "id", "outcome", "failures", *seconds)


TARGETS = {"view": "UNDER_REVIEW", "click": "APPROVED", "purchase": "PUBLISHED", "signup": "DRAFT", "error": "ARCHIVED"}


@query(
    """WITH RECURSIVE a AS (SELECT user_id AS item_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
      event_id % 10 <> 3 AS permitted, event_id % 7 AS actor, epoch_us(ts) // 1000000 AS t,
      CASE event_type WHEN 'view' THEN 'UNDER_REVIEW' WHEN 'click' THEN 'APPROVED' WHEN 'purchase' THEN 'PUBLISHED' WHEN 'signup' THEN 'DRAFT' ELSE 'ARCHIVED' END AS target FROM events),
    s AS (
      SELECT item_id, 0::BIGINT AS n, 'DRAFT' AS status, NULL::BIGINT AS seq, NULL::VARCHAR AS target, NULL::BOOLEAN AS accepted,
        NULL::BIGINT AS reviewed_by, NULL::BIGINT AS approved_at, NULL::BIGINT AS published_by, NULL::BIGINT AS archived_at FROM (SELECT DISTINCT item_id FROM a)
      UNION ALL
      SELECT s.item_id, a.n, CASE WHEN ok THEN a.target ELSE s.status END, a.seq, a.target, ok,
        CASE WHEN ok AND a.target = 'APPROVED' THEN actor WHEN ok AND a.target = 'UNDER_REVIEW' THEN NULL ELSE s.reviewed_by END,
        CASE WHEN ok AND a.target = 'APPROVED' THEN t ELSE s.approved_at END, CASE WHEN ok AND a.target = 'PUBLISHED' THEN actor ELSE s.published_by END,
        CASE WHEN ok AND a.target = 'ARCHIVED' THEN t ELSE s.archived_at END
      FROM s JOIN a ON a.item_id = s.item_id AND a.n = s.n + 1
      CROSS JOIN LATERAL (SELECT permitted AND ((a.target = 'UNDER_REVIEW' AND s.status = 'DRAFT') OR (a.target = 'APPROVED' AND s.status = 'UNDER_REVIEW')
        OR (a.target = 'PUBLISHED' AND s.status = 'APPROVED') OR (a.target = 'DRAFT' AND s.status IN ('UNDER_REVIEW', 'APPROVED'))
        OR (a.target = 'ARCHIVED' AND s.status <> 'ARCHIVED')) AS ok))
    SELECT item_id, seq, target, accepted, status, reviewed_by, approved_at, published_by, archived_at FROM s WHERE seq IS NOT NULL"""
)
def knowledge_transitions(spark, sf_dir):
    """Events as requests: the user is the item, the event type the status asked for; a
    tenth of them lack the permission."""
    target = F.element_at(F.create_map(*(F.lit(x) for kv in TARGETS.items() for x in kv)), F.col("event_type"))
    requests = st.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), target.alias("target"), (F.col("event_id") % 7).alias("user_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 10 != 3).alias("permitted"),
    )
    return workflow.knowledge_transitions(requests).drop("reviewed_at", "approved_by", "published_at")


@query(
    f"""SELECT 'knowledge' AS resource_type, item_id AS resource_id, seq, CASE target WHEN 'UNDER_REVIEW' THEN 'KNOWLEDGE_SUBMIT' WHEN 'APPROVED' THEN 'KNOWLEDGE_APPROVE'
      WHEN 'PUBLISHED' THEN 'KNOWLEDGE_PUBLISH' WHEN 'DRAFT' THEN 'KNOWLEDGE_REJECT' ELSE 'KNOWLEDGE_ARCHIVE' END AS event_code,
      '{{"previousStatus":"' || previous || '","newStatus":"' || status || '"}}' AS metadata
    FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY item_id ORDER BY seq), 'DRAFT') AS previous FROM ({SQL["knowledge_transitions"]})) WHERE accepted"""
)
def knowledge_events(spark, sf_dir):
    """The audit events of the accepted requests."""
    return review.knowledge_events(knowledge_transitions(spark, sf_dir))


@query(
    """WITH a AS (SELECT user_id AS item_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'approve' WHEN 'purchase' THEN 'publish'
      WHEN 'signup' THEN 'reject' ELSE 'archive' END AS action, event_id % 7 AS actor, CASE WHEN event_id % 2 = 0 THEN props END AS notes
      FROM events WHERE event_id % 10 <> 3)
    SELECT item_id, CASE max_by(action, seq) WHEN 'submit' THEN 'SUBMITTED' WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'CHANGES_REQUESTED' WHEN 'publish' THEN 'PUBLISHED' ELSE 'ARCHIVED' END AS status,
      max_by(ts, seq) FILTER (action = 'submit') AS submitted_at, max_by(actor, seq) FILTER (action = 'submit') AS submitted_by,
      max_by(ts, seq) FILTER (action = 'approve') AS approved_at, max_by(actor, seq) FILTER (action = 'approve') AS approved_by,
      max_by(ts, seq) FILTER (action = 'reject') AS reviewed_at, max_by(actor, seq) FILTER (action = 'reject') AS reviewed_by,
      max_by(ts, seq) FILTER (action = 'publish') AS published_at, max_by(actor, seq) FILTER (action = 'publish') AS published_by,
      max_by(ts, seq) FILTER (action = 'archive') AS archived_at, max_by(notes, seq) FILTER (action IN ('approve', 'reject') AND notes IS NOT NULL) AS review_notes,
      coalesce(max_by(action = 'archive', seq) FILTER (action IN ('archive', 'publish')), false) AS embedding_cleared FROM a GROUP BY item_id"""
)
def experience_transitions(spark, sf_dir):
    actions = {"view": "submit", "click": "approve", "purchase": "publish", "signup": "reject", "error": "archive"}
    action = F.element_at(F.create_map(*(F.lit(x) for kv in actions.items() for x in kv)), F.col("event_type"))
    requests = st.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), action.alias("action"), "ts", (F.col("event_id") % 7).alias("user_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("notes"), (F.col("event_id") % 10 != 3).alias("permitted"),
    )
    return workflow.experience_transitions(requests)


@query(
    f"""WITH {st.JOBS_SQL}, f AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS failed, bool_or(l_returnflag = 'A') AS done,
      max(l_shipdate)::TIMESTAMP AS started_at, max(l_receiptdate)::TIMESTAMP AS last_at, (max(l_receiptdate) FILTER (l_returnflag = 'A'))::TIMESTAMP AS done_at
      FROM (SELECT l_orderkey, l_returnflag, l_shipdate, l_shipdate + INTERVAL 2 DAY AS l_receiptdate FROM lineitem) WHERE l_returnflag <> 'N' GROUP BY 1),
    o AS (SELECT *, retry_count + coalesce(failed, 0) AS n,
      CASE WHEN failed IS NULL THEN status WHEN done THEN 'COMPLETED' WHEN retry_count + failed < max_retries THEN 'PENDING' ELSE 'FAILED' END AS now
      FROM jobs LEFT JOIN f USING (id))
    SELECT id, n AS retry_count, now AS status, started_at, CASE WHEN now = 'COMPLETED' THEN done_at WHEN now = 'FAILED' AND failed IS NOT NULL THEN last_at END AS completed_at FROM o"""
)
def job_outcomes(spark, sf_dir):
    """Line items as runs of an order's job: returned ones failed, accepted ones went well,
    open ones did not run."""
    runs = st.table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_returnflag") == "A").alias("ok"), F.col("l_shipdate").cast("timestamp").alias("started_at"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("ended_at"),
    )
    return workflow.job_outcomes(st.jobs(spark, sf_dir), runs)


@query(
    f"""WITH {st.AUDIT_SQL} SELECT id, event_code, CASE WHEN event_code = 'FAILED_LOGIN' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome, 'INFO' AS severity, metadata FROM audit"""
)
def append_events(spark, sf_dir):
    """Audit rows as they are appended: with their defaults."""
    events = st.audit(spark, sf_dir).withColumn("outcome", F.when(F.col("event_code") == "FAILED_LOGIN", "FAILURE"))
    return tables.with_event_defaults(events).select("id", "event_code", "outcome", "severity", "metadata")
