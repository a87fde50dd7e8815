"""Replays of review workflows and jobs over ordered requests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bounds import small
from tidemark.operators.segments import pieces_of, streamed
from tidemark.sources.shared import save

# ---- fixed values: from which status each target may be reached, and what actions set
ALLOWED_FROM = {
    "UNDER_REVIEW": ("DRAFT",),
    "APPROVED": ("UNDER_REVIEW",),
    "PUBLISHED": ("APPROVED",),
    "DRAFT": ("UNDER_REVIEW", "APPROVED"),
    "ARCHIVED": ("PUBLISHED", "APPROVED", "DRAFT", "UNDER_REVIEW"),
}
ACTIONS = {
    "submit": "SUBMITTED",
    "approve": "APPROVED",
    "reject": "CHANGES_REQUESTED",
    "publish": "PUBLISHED",
    "archive": "ARCHIVED",
}
#: Permissions that the changes need.
KNOWLEDGE_PERMISSIONS = {
    "UNDER_REVIEW": "knowledge.update",
    "APPROVED": "knowledge.approve",
    "PUBLISHED": "knowledge.publish",
    "DRAFT": "knowledge.review",
    "ARCHIVED": "knowledge.update",
}
EXPERIENCE_PERMISSIONS = {
    "submit": "experience.submit",
    "approve": "experience.approve",
    "reject": "experience.review",
    "publish": "experience.publish",
    "archive": "experience.update",
}
#: Stamps that an accepted target sets; submitting clears the reviewer's.
STAMPS = {"APPROVED": ("reviewed", "approved"), "PUBLISHED": ("published",), "ARCHIVED": ("archived",)}
CLEARED = {"UNDER_REVIEW": ("reviewed",)}
#: Stamps that actions on lessons set, and those of them with the name of who acted.
ACTION_STAMPS = {"submit": "submitted", "approve": "approved", "reject": "reviewed", "publish": "published", "archive": "archived"}
# ---- end of fixed values
_STAMPED = ("reviewed", "approved", "published", "archived")


#: Requests of an item from which its replay is cut in pieces that run side by side.
HOT_REQUESTS = 1_000_000


class _Item:
    """The status of an item and its stamps: name to (user, time), None where it is cleared."""

    def __init__(self, status: str = "DRAFT", stamps: dict | None = None):
        self.status, self.stamps = status, dict(stamps or {})

    def step(self, target: str, able: bool, user, ts) -> bool:
        if not able or self.status not in ALLOWED_FROM.get(target, ()):
            return False
        self.status = target
        for s in STAMPS.get(target, ()):
            self.stamps[s] = (user, ts)
        for s in CLEARED.get(target, ()):
            self.stamps[s] = (None, None)
        return True


def _requests_of(batch: pa.RecordBatch, stamped: bool) -> Iterator[tuple]:
    """((item, piece), target, permitted, user, time) of a batch's rows."""
    none = [None] * batch.num_rows
    users, times = (batch[c].to_pylist() for c in ("user_id", "ts")) if stamped else (none, none)
    return zip(zip(batch["item_id"].to_pylist(), batch["piece"].to_pylist()), batch["target"].to_pylist(), batch["permitted"].to_pylist(), users, times)


def knowledge_transitions(requests: DataFrame, hot_requests: int = HOT_REQUESTS) -> DataFrame:
    """(item_id, seq, target, accepted, status) of requests (item_id, seq, target): each is
    accepted if the status reached so far allows it and, where there is a column permitted,
    that is not false. Items begin as drafts; requests without a target change nothing and
    are left out. With columns user_id and ts the stamps follow as they are after the
    request: reviewed_by, reviewed_at and so on; archiving has a time only.

    Requests stream through a task in the order of their item; it holds one status and its
    stamps. The requests of an item with hot_requests or more are cut in pieces: a piece is
    replayed from each of the five statuses, which makes it a map of statuses with the stamps
    that it sets; the maps, a few rows a piece, are followed from the draft on; and then all
    pieces are replayed side by side, each from the status that it begins with.
    """
    kinds = dict(requests.dtypes)
    stamped = "user_id" in kinds and "ts" in kinds
    permitted = F.coalesce("permitted", F.lit(True)) if "permitted" in kinds else F.lit(True)
    carried = ["user_id", "ts"] if stamped else []
    rows = requests.filter("target <> ''").select("item_id", F.col("seq").cast("long").alias("seq"), "target", *carried, permitted.alias("permitted"))
    stamps = [(s, what, kinds["user_id"] if what == "by" else kinds["ts"]) for s in _STAMPED for what in ("by", "at") if (s, what) != ("archived", "by")] if stamped else []
    begun = ", ".join(["begins string", *(f"{s}_{what}_0 {kind}" for s, what, kind in stamps)])
    none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in begun.split(", ")}

    def values(item: _Item) -> list:
        return [item.stamps.get(s, (None, None))[what == "at"] for s, what, _ in stamps]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, item = None, _Item()
        for batch in batches:
            starts, olds = batch["begins"].to_pylist(), [batch[f"{s}_{what}_0"].to_pylist() for s, what, _ in stamps]
            accepted, reached, after = [], [], [[] for _ in stamps]
            for i, (key, target, able, user, ts) in enumerate(_requests_of(batch, stamped)):
                if owner is None or key != owner:
                    owner, old = key, {}
                    for (s, what, _), column in zip(stamps, olds, strict=True):
                        by, at = old.get(s, (None, None))
                        old[s] = (column[i], at) if what == "by" else (by, column[i])
                    item = _Item(starts[i] or "DRAFT", old)
                accepted.append(item.step(target, able, user, ts))
                reached.append(item.status)
                for column, value in zip(after, values(item), strict=True):
                    column.append(value)
            data = [*batch.select(["item_id", "seq", "target"]).columns, pa.array(accepted, pa.bool_()), pa.array(reached, pa.string())]
            data += [pa.array(v, batch["user_id" if what == "by" else "ts"].type) for v, (_, what, _) in zip(after, stamps, strict=True)]
            yield pa.RecordBatch.from_arrays(data, names=["item_id", "seq", "target", "accepted", "status", *(f"{s}_{what}" for s, what, _ in stamps)])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each piece and status that it may begin with: the status that it ends with, and
        the stamps that it sets (set_<name>) with their values."""
        owner, items, kept = None, [], None

        def said() -> pa.RecordBatch:
            whose, piece = owner
            columns = [pa.array([whose] * 5, kept["item_id"].type), pa.array([piece] * 5, pa.int64()), pa.array([*ALLOWED_FROM]), pa.array([x.status for x in items])]
            for s, what, _ in stamps:
                at = int(what == "at")
                columns += [pa.array([s in x.stamps for x in items]), pa.array([x.stamps.get(s, (None, None))[at] for x in items], kept["ts" if at else "user_id"].type)]
            names = ["item_id", "piece", "begins", "ends", *(n for s, what, _ in stamps for n in (f"set_{s}_{what}", f"{s}_{what}"))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for key, target, able, user, ts in _requests_of(batch, stamped):
                if key != owner:
                    if owner is not None:
                        yield said()
                    owner, items, kept = key, [_Item(status) for status in ALLOWED_FROM], batch
                for item in items:
                    item.step(target, able, user, ts)
        if owner is not None:
            yield said()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The status and stamps that each piece begins with, of maps in order."""
        owner, status, now, piece, ahead = None, "DRAFT", {}, None, None
        for batch in batches:
            out, rows_of = [], batch.to_pylist()
            for r in rows_of:
                if owner is None or r["item_id"] != owner[0]:
                    owner, status, now, piece, ahead = (r["item_id"],), "DRAFT", {}, None, None
                if r["piece"] != piece:  # the one before has been read
                    if ahead is not None:
                        status, now = ahead
                    piece = r["piece"]
                    out.append((r["item_id"], piece, status, *(now.get(f"{s}_{what}") for s, what, _ in stamps)))
                if r["begins"] == status:
                    set_ = {f"{s}_{what}": r[f"{s}_{what}"] for s, what, _ in stamps if r[f"set_{s}_{what}"]}
                    ahead = (r["ends"], {**now, **set_})
            kinds_of = [batch["item_id"].type, pa.int64(), pa.string(), *(batch[f"{s}_{what}"].type for s, what, _ in stamps)]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds_of), kinds_of, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "piece", *(c.split()[0] for c in begun.split(", "))])

    schema = f"item_id {kinds['item_id']}, seq long, target string, accepted boolean, status string"
    schema = ", ".join([schema, *(f"{s}_{what} {kind}" for s, what, kind in stamps)])
    order = ["item_id", "piece", "seq", "target"]
    hot = rows.groupBy("item_id").agg(F.count("*").alias("n")).filter(F.col("n") >= hot_requests).select("item_id")
    hot = save(hot.filter("item_id IS NOT NULL"), "hot-items")
    n_hot = hot.count()
    whole = rows if not n_hot else rows.join(small(hot, n_hot, 64), "item_id", "left_anti")
    whole = whole.withColumns({"piece": F.lit(0).cast("long"), **none})
    done = streamed(whole, order[:1], *order[1:]).mapInArrow(replay, schema)
    if not n_hot:
        return done
    cut = pieces_of(rows.join(small(hot, n_hot, 64), "item_id", "left_semi"), ["item_id"], ["seq", "target"], "piece", "at")
    of_map = ", ".join(f"set_{s}_{what} boolean, {s}_{what} {kind}" for s, what, kind in stamps)
    mapped = streamed(cut, ["item_id", "piece"], "at").mapInArrow(
        maps, f"item_id {kinds['item_id']}, piece long, begins string, ends string" + (f", {of_map}" if of_map else "")
    )
    starts = save(streamed(mapped, ["item_id"], "piece").mapInArrow(follow, f"item_id {kinds['item_id']}, piece long, {begun}"), "starts")
    ready = streamed(cut.join(small(starts, starts.count(), 256), ["item_id", "piece"]), ["item_id", "piece"], "at")
    return done.unionByName(ready.mapInArrow(replay, schema))


def experience_transitions(requests: DataFrame) -> DataFrame:
    """(item_id, status, stamps, review_notes, embedding_cleared) of requests (item_id, seq,
    action, ts, user_id, notes); where there is a column permitted, those of false change
    nothing. The last action sets the status, whatever it was before; each action keeps who
    did it last and when (archiving: when), approving and rejecting their last notes that
    are not null; after archiving an item has no vector until it is published again."""
    status = F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), F.col("action"))
    rows = requests.filter(F.coalesce("permitted", F.lit(True))) if "permitted" in requests.columns else requests
    rows, last = rows.filter(F.col("action").isin(*ACTIONS)), []
    for action, stamp in ACTION_STAMPS.items():
        is_it = F.col("action") == action
        last.append(F.max_by("ts", F.when(is_it, F.col("seq"))).alias(f"{stamp}_at"))
        if action != "archive":
            last.append(F.max_by("user_id", F.when(is_it, F.col("seq"))).alias(f"{stamp}_by"))
    noted = F.col("action").isin("approve", "reject") & F.col("notes").isNotNull()
    vector = F.max_by(F.col("action") == "archive", F.when(F.col("action").isin("archive", "publish"), F.col("seq")))
    return rows.groupBy("item_id").agg(
        F.max_by(status, "seq").alias("status"), *last, F.max_by("notes", F.when(noted, F.col("seq"))).alias("review_notes"),
        F.coalesce(vector, F.lit(False)).alias("embedding_cleared"),
    )


def job_outcomes(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, retry_count, status, started_at, completed_at) of jobs (id, status, retry_count,
    max_retries) after runs (job_id, ok, started_at, ended_at). A run that went well
    completes its job; a failed one counts a retry, and the job is pending again while
    retries are left, failed after. A job that never ran keeps its status.

    Columns may be missing: without ok all runs failed, without status all jobs were
    pending, without times the stamps are null.
    """
    has = lambda df, name, other: F.col(name) if name in df.columns else F.lit(other)
    ok, ended = has(runs, "ok", False), has(runs, "ended_at", None).cast("timestamp")
    counts = runs.groupBy(F.col("job_id").alias("id")).agg(
        F.count_if(~ok).alias("failed"), F.bool_or(ok).alias("done"), F.max(has(runs, "started_at", None).cast("timestamp")).alias("started_at"),
        F.max(F.when(ok, ended)).alias("done_at"), F.max(ended).alias("last_at"),
    )
    n = F.col("retry_count") + F.coalesce("failed", F.lit(0).cast("long"))
    rows = jobs.select("id", "retry_count", "max_retries", has(jobs, "status", "PENDING").alias("own")).join(counts, "id", "left")
    status = F.when(F.col("failed").isNull(), F.col("own")).when(F.col("done"), "COMPLETED").when(n < F.col("max_retries"), "PENDING").otherwise("FAILED")
    completed = F.when(status == "COMPLETED", F.col("done_at")).when((status == "FAILED") & F.col("failed").isNotNull(), F.col("last_at"))
    return rows.select("id", n.alias("retry_count"), status.alias("status"), "started_at", completed.alias("completed_at"))
