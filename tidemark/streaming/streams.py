"""The batch jobs as Structured Streaming jobs, with the same results on finite input.

Limits and lockouts take attempts in any order within the lateness that is allowed, decide
them once the watermark has passed, and give all columns of the batch jobs. A finite stream
ends with what its last watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.streaming.replay import LIMITS, WINDOW_MOST, WINDOW_SECONDS, limit_of
from tidemark.streaming.state import NEVER, Lockout, SlidingLog, keep_state

LATENESS = "10 minutes"


def stream_fixed_window_limit(attempts: DataFrame, seconds: int = WINDOW_SECONDS, most: int = WINDOW_MOST) -> DataFrame:
    """Counts of tumbling windows for each key, final once the watermark has passed."""
    counts = (
        attempts.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", LATENESS)
        .groupBy("key", F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n"))
    )
    return counts.select("key", F.col("w.start").alias("window_start"), "n", (F.col("n") <= most).alias("allowed"))


def stream_sliding_log_limit(attempts: DataFrame, limits=LIMITS, lateness: str = LATENESS) -> DataFrame:
    """sliding_log_limit over a stream of attempts (key, action, ts, id), ts and id not null.
    State: what waits for the watermark, and the accepted times of the window, which are gone
    once the watermark has passed it (so that a stored log of attempts needs no purge)."""
    keep_state(attempts.sparkSession)  # keys are text in there: numbers with nulls would turn into floats
    most, seconds = limit_of(F.col("action"), limits)
    kinds = dict(attempts.dtypes)
    rows = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        F.col("key").cast("string").alias("key"), "action", "ts", F.unix_micros("ts").alias("t"), "id", most.cast("long").alias("most"), seconds.cast("long").alias("seconds")
    )
    log = SlidingLog(["t", "id", "most", "seconds"], f"t long, id {kinds['id']}, most long, seconds long", ["key", "action", "t", "id", "allowed", "remaining", "reset"])
    schema = f"key string, action string, t long, id {kinds['id']}, allowed boolean, remaining long, reset long"
    timed = rows.groupBy("key", "action").transformWithStateInPandas(log, schema, "append", "EventTime")
    return timed.withColumns({"key": F.col("key").cast(kinds["key"]), "ts": F.timestamp_micros("t"), "reset_at": F.timestamp_micros("reset")}).drop("t", "reset")


def stream_login_lockout(attempts: DataFrame, users: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """login_lockout over a stream of attempts (user_id, ts, id, success), ts and id not null.
    Users (id, is_active), with their stored failed_login_attempts, locked_until and last_login
    where users has these columns, are the state that the stream begins with."""
    keep_state(attempts.sparkSession)
    kinds = dict(attempts.dtypes)
    rows = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).select(
        F.col("user_id").cast("string").alias("user_id"), "ts", F.unix_micros("ts").alias("t"), "id", F.coalesce("success", F.lit(False)).alias("success")
    )
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp")) if name in users.columns else F.lit(None).cast("long")
    failed = F.col("failed_login_attempts").cast("long") if "failed_login_attempts" in users.columns else F.lit(0).cast("long")
    known = users.filter("id IS NOT NULL").select(
        F.col("id").cast("string").alias("user_id"), F.coalesce("is_active", F.lit(False)).alias("is_active"),
        F.coalesce(failed, F.lit(0).cast("long")).alias("failures"), F.coalesce(micros("locked_until"), F.lit(0).cast("long")).alias("locked"),
        F.coalesce(micros("last_login"), F.lit(NEVER)).alias("seen"),
    ).groupBy("user_id")
    lockout = Lockout(["t", "id", "success"], f"t long, id {kinds['id']}, success boolean", ["user_id", "id", "outcome", "failures", "locked", "seen"])
    schema = f"user_id string, id {kinds['id']}, outcome string, failures long, locked long, seen long"
    steps = rows.groupBy("user_id").transformWithStateInPandas(lockout, schema, "append", "EventTime", initialState=known)
    return steps.withColumns({"user_id": F.col("user_id").cast(kinds["user_id"]), "locked_until": F.timestamp_micros("locked"), "last_login": F.timestamp_micros("seen")}).drop("locked", "seen")
