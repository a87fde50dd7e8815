"""Request-time limits and lockouts replayed over event logs, in batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import streamed

# ---- fixed values: attempts allowed and minutes, by action
LIMITS = {"login": (5, 15), "chat": (30, 1), "upload": (10, 60), "default": (100, 60)}
WINDOW_SECONDS, WINDOW_MOST = 60, 60
LOCK_AFTER, LOCK_MINUTES, KEEP_HOURS = 5, 15, 1
# ---- end of fixed values


def _micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def limit_of(action: Column, limits: dict[str, tuple[int, int]] = LIMITS) -> tuple[Column, Column]:
    """Attempts allowed and window in seconds of an action."""
    pick = lambda i, scale: F.coalesce(
        F.element_at(F.create_map(*(F.lit(x) for k, v in limits.items() for x in (k, v[i] * scale))), action),
        F.lit(limits["default"][i] * scale),
    )
    return pick(0, 1), pick(1, 60)


def attempts_in_window(attempts: DataFrame, as_of: Column, limits=LIMITS) -> DataFrame:
    """(key, action, n, allowed, remaining) of the attempts in each action's window."""
    most, seconds = limit_of(F.col("action"), limits)
    recent = attempts.filter(_micros("ts") >= _micros(as_of) - seconds.cast("long") * 1_000_000)
    n = F.col("n")
    return recent.groupBy("key", "action").agg(F.count("*").alias("n")).select(
        "key", "action", "n", (n < most).alias("allowed"), F.greatest(F.lit(0).cast("long"), most - n - 1).alias("remaining")
    )


def fixed_window_counts(attempts: DataFrame, seconds: int = WINDOW_SECONDS, most: int = WINDOW_MOST) -> DataFrame:
    """(key, window_start, n, allowed, remaining) of tumbling windows."""
    counts = attempts.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return counts.select(
        "key", F.col("w.start").alias("window_start"), "n", (F.col("n") <= most).alias("allowed"),
        F.greatest(F.lit(0).cast("long"), most - F.col("n")).alias("remaining"),
    )


def expire_attempts(attempts: DataFrame, as_of: Column, hours: int = KEEP_HOURS) -> DataFrame:
    """Attempts that are still kept: of the last hour."""
    return attempts.filter(F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def admit(times: list[int], accepted: deque, most: int, window: int) -> list[bool]:
    """Decisions on times in order; accepted holds the accepted ones in the window."""
    out = []
    for t in times:
        while accepted and accepted[0] < t - window:
            accepted.popleft()
        out.append(len(accepted) < most)
        if out[-1]:
            accepted.append(t)
    return out


def sliding_log_limit(attempts: DataFrame, limits=LIMITS) -> DataFrame:
    """attempts (key, action, ts, id) with allowed, remaining and reset_at: an attempt is
    denied, and not counted, if the window before it holds as many accepted ones as the
    limit; remaining tells how many more fit, reset_at when the window begun now is over.
    At equal times the smaller id comes first; attempts without a key share one limit.

    Attempts stream through a task in the order of their key; it holds the accepted
    times of one key's window, at most as many as the limit.
    """
    most, seconds = limit_of(F.col("action"), limits)
    rows = attempts.select("key", "action", _micros("ts").alias("t"), "id", most.alias("most"), seconds.alias("seconds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, accepted = (), deque()
        for batch in batches:
            allowed, left, reset = [], [], []
            for key, action, t, n, s in zip(*(batch[c].to_pylist() for c in ("key", "action", "t", "most", "seconds")), strict=True):
                if (key, action) != owner:
                    owner, accepted = (key, action), deque()
                allowed += admit([t], accepted, n, s * 1_000_000)
                left.append(n - len(accepted) if allowed[-1] else 0)
                reset.append(t + s * 1_000_000)
            new = [pa.array(allowed, pa.bool_()), pa.array(left, pa.int64()), pa.array(reset, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["key", "action", "t", "id"]).columns, *new], ["key", "action", "t", "id", "allowed", "remaining", "reset"]
            )

    kinds = dict(attempts.dtypes)
    schema = f"key {kinds['key']}, action string, t long, id {kinds['id']}, allowed boolean, remaining long, reset long"
    ordered = streamed(rows, ["key", "action"], "t", "id")
    timed = ordered.mapInArrow(run, schema)
    return timed.withColumns({"ts": F.timestamp_micros("t"), "reset_at": F.timestamp_micros("reset")}).drop("t", "reset")


def login_steps(state: dict, attempts: list[tuple]) -> list[tuple]:
    """(id, outcome, failures) of one user's attempts (id, micros, known, active, success)
    in order. state: failures and locked_until, changed in place."""
    out = []
    for attempt, t, known, active, success in attempts:
        if not known:
            outcome = "user_not_found"
        elif state["locked_until"] > t:
            outcome = "account_locked"
        elif not active:
            outcome = "account_inactive"
        elif success:
            outcome = "success"
            state |= {"failures": 0, "locked_until": 0}
        else:
            outcome = "wrong_password"
            failures = state["failures"] + 1
            state |= {"failures": failures, "locked_until": t + LOCK_MINUTES * 60_000_000 if failures >= LOCK_AFTER else 0}
        out.append((attempt, outcome, state["failures"]))
    return out


def login_lockout(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, id, outcome, failures, locked_until, last_login) of attempts (user_id, ts,
    id, success) in order; users (id, is_active), who begin with their stored
    failed_login_attempts, locked_until and last_login where users has these columns. After
    a lock ends the failures are kept, so the next failure locks again. Attempts without a
    user, or of one that is not known, change nothing.
    """
    stored = {name: F.col(name) if name in users.columns else F.lit(None).cast(kind) for name, kind in (("failed_login_attempts", "long"), ("locked_until", "timestamp"), ("last_login", "timestamp"))}
    known = users.select(
        F.col("id").alias("user_id"), F.lit(True).alias("known"), "is_active",
        F.coalesce(stored["failed_login_attempts"].cast("long"), F.lit(0).cast("long")).alias("failures"),
        F.coalesce(_micros(stored["locked_until"]), F.lit(0).cast("long")).alias("locked"), _micros(stored["last_login"]).alias("seen"),
    )
    rows = attempts.join(known, "user_id", "left").select(
        "user_id", "id", _micros("ts").alias("t"), F.coalesce("known", F.lit(False)).alias("known"),
        F.coalesce("is_active", F.lit(False)).alias("is_active"), "success", "failures", "locked", "seen",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, seen = (), {}, None
        for batch in batches:
            out = []
            for user, *attempt, failures, locked, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (user,) != owner:
                    owner, state, seen = (user,), {"failures": failures or 0, "locked_until": locked or 0}, last
                [(_, outcome, failed)] = login_steps(state, [tuple(attempt)])
                seen = attempt[1] if outcome == "success" else seen
                out.append((outcome, failed, state["locked_until"] or None, seen))
            new = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()))] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], ["user_id", "id", "outcome", "failures", "locked", "seen"])

    kinds = dict(rows.dtypes)
    schema = f"user_id {kinds['user_id']}, id {kinds['id']}, outcome string, failures long, locked long, seen long"
    steps = streamed(rows, ["user_id"], "t", "id").mapInArrow(run, schema)
    return steps.withColumns({"locked_until": F.timestamp_micros("locked"), "last_login": F.timestamp_micros("seen")}).drop("locked", "seen")
