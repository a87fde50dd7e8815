"""Streaming jobs give what the batch jobs give on a finite input."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tidemark.operators import index
from tidemark.plans import ingest
from tidemark.plans import standins as st
from tidemark.sources import files
from tidemark.streaming import replay, streams


def as_stream(spark, df, tmp_path, name, parts=1):
    """A file stream of df, in as many files as parts, read one at a time in order."""
    import time

    path = tmp_path / name
    for n in range(parts):
        df.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    query = q.trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_fixed_windows(spark, sf_dir, tmp_path):
    attempts = st.attempts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = replay.fixed_window_counts(attempts, 12 * 3600, 2)
    source = as_stream(spark, attempts.withColumn("part", F.lit(0)), tmp_path, "fixed")
    got = run(streams.stream_fixed_window_limit(source, 12 * 3600, 2), "fixed_out", tmp_path, "update")
    key = lambda df: sorted((r.key, r.window_start, r.n, r.allowed) for r in df.collect())
    assert key(got) == key(batch)


def jittered(df, days=2):
    """df in files by time, with each row up to some days late."""
    late = F.pmod(F.xxhash64("id"), F.lit(days * 86400))
    day = F.datediff(F.timestamp_seconds(F.unix_seconds("ts") + late), F.lit(dt.date(2024, 1, 1)))
    return df.withColumn("part", F.least(F.greatest(F.floor(day / 6), F.lit(0)), F.lit(5)).cast("int"))


def with_end(df, **values):
    """df with one last row, far behind all others, that moves the watermark past them."""
    end = {"ts": F.to_timestamp(F.lit("2025-01-01")), "id": F.lit(-1).cast(dict(df.dtypes)["id"]), "part": F.lit(6)}
    row = df.limit(1).withColumns({**end, **{k: F.lit(v).cast(dict(df.dtypes)[k]) for k, v in values.items()}})
    return df.unionByName(row)


def rows_of(df, *columns):
    return {tuple(str(r[c]) for c in columns) for r in df.filter("id <> -1").select(*columns).collect()}


def kept_state(spark, tmp_path, name, variable):
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return [r for r in reader.load(str(tmp_path / f"{name}-cp")).collect()]


def test_sliding_limit(spark, sf_dir, tmp_path):
    """Late attempts are decided in order of time, in all columns of the batch, and what a
    window held is gone once it is over."""
    attempts = st.attempts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    attempts = attempts.withColumn("key", F.when(F.col("key") != attempts.first().key, F.col("key")))  # one key is null
    batch = replay.sliding_log_limit(attempts, st.TEST_LIMITS)
    late = with_end(jittered(attempts), key=-99)
    source = as_stream(spark, late, tmp_path, "sliding", 7)
    got = run(streams.stream_sliding_log_limit(source, st.TEST_LIMITS, "3 days"), "sliding_out", tmp_path)
    columns = ("key", "action", "id", "ts", "allowed", "remaining", "reset_at")
    assert rows_of(got, *columns) == rows_of(batch, *columns)
    assert got.count() == batch.count() and not all(r.allowed for r in batch.collect())
    assert kept_state(spark, tmp_path, "sliding_out", "accepted") == []
    assert {r.key[0] for r in kept_state(spark, tmp_path, "sliding_out", "waiting")} == {"-99"}


def test_lockout(spark, sf_dir, tmp_path):
    """The stream begins with what is stored of the users, and gives what the batch gives."""
    events = st.table(spark, sf_dir, "events")
    attempts = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("success"))
    users = events.select(F.col("user_id").alias("id")).distinct().filter("id % 11 <> 3").withColumns({
        "is_active": F.col("id") % 7 != 0, "failed_login_attempts": F.when(F.col("id") % 3 == 0, 4),
        "locked_until": F.when(F.col("id") % 4 == 0, F.to_timestamp(F.lit("2024-01-03 12:00:00"))),
        "last_login": F.when(F.col("id") % 2 == 0, F.to_timestamp(F.lit("2023-12-24 18:00:00"))),
    })
    attempts = attempts.withColumn("user_id", F.when(F.col("user_id") != 13, F.col("user_id")))  # some have no user
    batch = replay.login_lockout(attempts, users)
    source = as_stream(spark, with_end(jittered(attempts), user_id=-1), tmp_path, "lockout", 7)
    got = run(streams.stream_login_lockout(source, users, "3 days"), "lockout_out", tmp_path)
    columns = ("user_id", "id", "outcome", "failures", "locked_until", "last_login")
    assert rows_of(got, *columns) == rows_of(batch, *columns)
    assert {r.outcome for r in batch.collect()} >= {"success", "wrong_password", "account_locked", "account_inactive", "user_not_found"}


FILES = {
    "a.txt": "\ufeff# Pumps\n\nCheck the pump.\n\nThen stop.".encode(), "b.csv": b"x;y\n1;2\n", "c.exe": b"no", "d.docx": b"no archive", "e.txt": b"known before",
    "f.txt": "\ufeff# Pumps\n\nCheck the pump.\n\nThen stop.".encode(), "g.md": b"  \n ", "h [1]*.txt": b"Odd name", "i.txt": b"Odd name", "j.txt": b"known before",
}


def of(name):
    return f"org1/{name}"


OUTCOMES = {
    of("a.txt"): ("completed", None, None), of("b.csv"): ("completed", None, None), of("c.exe"): ("rejected", "bad_ext", None),
    of("d.docx"): ("rejected", "corrupt", None), of("e.txt"): ("duplicate", None, "s1"), of("f.txt"): ("duplicate", None, of("a.txt")),
    of("g.md"): ("failed", None, None), of("h [1]*.txt"): ("completed", None, None), of("i.txt"): ("duplicate", None, of("h [1]*.txt")),
    of("j.txt"): ("duplicate", None, "s1"),
}


def put_files(tmp_path, names):
    folder = tmp_path / "files" / "org1" / "documents"
    folder.mkdir(parents=True, exist_ok=True)
    for name in names:
        (folder / name).write_bytes(FILES[name])


def stored_before(spark):
    rows = [("s1", "org1", hashlib.sha256(b"known before").hexdigest(), None)]
    return spark.createDataFrame(rows, "id string, organization_id string, sha256 string, deleted_at timestamp")


def outcomes_of(spark, tmp_path):
    found = spark.read.parquet(str(tmp_path / "target" / "outcomes")).collect()
    assert len(found) == len({r.id for r in found})
    return {r.id: (r.status, r.reason, r.existing_id) for r in found}


def chunks_of(df):
    return sorted((r.chunk_id, r.organization_id, r.section or "", r.content, tuple(r.embedding)) for r in df.collect())


def test_files_end_to_end(spark, tmp_path):
    """Files through a stream in two steps give the outcomes and chunks of one batch; contents
    are known over micro-batches; a micro-batch that runs again changes nothing."""
    target, checkpoint = str(tmp_path / "target"), tmp_path / "cp-files"

    def stream():
        ingest.stream_files(spark, str(tmp_path / "files"), str(checkpoint), stored_before(spark), target, 3, buckets=8).awaitTermination(300)

    for names in (list(FILES)[:5], list(FILES)[5:]):
        put_files(tmp_path, names)
        stream()
    streamed = ingest.stored_index(spark, target, 8).read()
    assert outcomes_of(spark, tmp_path) == OUTCOMES
    uploads = ingest.named_files(files.read_files(spark, str(tmp_path / "files")))
    outcomes, chunks = ingest.ingest_files(uploads, stored_before(spark))
    assert {r.id: (r.status, r.reason, r.existing_id) for r in outcomes.collect()} == OUTCOMES
    assert {r.page_count for r in outcomes.collect()} == {None}
    want = chunks_of(chunks)
    assert chunks_of(streamed) == want and any(r.section == "Pumps" for r in streamed.collect())

    # the last micro-batch was written, but not marked as done: it runs again, and so do all
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    stream()
    assert outcomes_of(spark, tmp_path) == OUTCOMES and chunks_of(ingest.stored_index(spark, target, 8).read()) == want

    # once uploads are stored documents, a batch of them all is decided as at first
    done = outcomes.filter("status = 'completed'").select("id", "organization_id", "sha256", F.lit(None).cast("timestamp").alias("deleted_at"))
    again, _ = ingest.ingest_files(uploads, stored_before(spark).unionByName(done))
    assert {r.id: (r.status, r.reason, r.existing_id) for r in again.collect()} == OUTCOMES

    lessons = spark.createDataFrame([("l1", "org1", "Seals", "It leaks", None, "PUBLISHED", False)], "id string, organization_id string, title string, problem_description string, tags array<string>, status string, is_deleted boolean")
    everything = index.replace_index(streamed, ingest.ingest_lessons(lessons).select(*streamed.columns))
    completed = outcomes.filter("status = 'completed'").select("id", "status", F.lit(False).alias("is_deleted"))
    live = index.live_sources(completed, lessons)
    assert {r.source_id for r in index.eligible_chunks(everything, live).collect()} == {of("a.txt"), of("b.csv"), of("h [1]*.txt"), "l1"}
    assert index.orphan_chunks(everything, live.filter("source_type = 'document'")).select("source_id").distinct().collect() == [("l1",)]


def test_a_micro_batch_twice(spark, tmp_path):
    """The same number with the same rows leaves the same outcomes, chunks and files of the index."""
    put_files(tmp_path, FILES)
    uploads = ingest.named_files(files.read_files(spark, str(tmp_path / "files")))
    slim = ingest.looked_at(uploads)
    known = index.duplicate_uploads(slim.filter("problem IS NULL"), stored_before(spark)).select("id", "existing_id")
    seen = slim.join(known, "id", "left").select(*(c.split()[0] for c in ingest._SEEN.split(", ")), "existing_id")
    found = []
    for _ in range(2):
        ingest.index_batch(spark, seen, str(tmp_path / "target"), 4, buckets=4)
        table = ingest.stored_index(spark, str(tmp_path / "target"), 4)
        found.append((outcomes_of(spark, tmp_path), chunks_of(table.read()), table.current()))
    assert found[0] == found[1] and found[0][0] == OUTCOMES


def test_deleted_documents_free_their_contents(spark, tmp_path):
    """A content is taken once in all micro-batches, and again after its document is deleted."""
    kinds = "id string, organization_id string, path string, file_name string, length long, sha256 string, problem string, gone boolean, part int"
    up = lambda i, org, sha, part, problem=None, gone=False: (i, org, f"/{i}", f"{i}.txt", 1, sha, problem, gone, part)
    rows = [
        up("b", "o", "x", 0), up("a", "o", "x", 0), up("n", None, "x", 0), up("p", "o", "y", 0, "bad_ext"), up("c", "o", "x", 1), up("a", "o", "x", 1),
        up("d", "o", "y", 1), up("t", "o", "z", 1), up("s", "o", "z", 2, gone=True), up("u", "o", "z", 3), up("e", "p", "x", 3), up("a", "o", "x", 4, gone=True),
        up("c", "o", "x", 5), up("b", "o", "x", 5),
    ]
    source = as_stream(spark, spark.createDataFrame(rows, kinds), tmp_path, "uploads", 6)
    stored = spark.createDataFrame([("s", "o", "z", None), ("old", "o", "y", dt.datetime(2024, 1, 1))], "id string, organization_id string, sha256 string, deleted_at timestamp")
    got = run(ingest.first_uploads(source.filter("NOT gone"), stored, source.filter("gone")), "uploads_out", tmp_path)
    held = [(r.id, r.organization_id, r.existing_id) for r in got.collect()]
    want = [("a", "o", None), ("b", "o", "a"), ("n", None, None), ("p", "o", None), ("c", "o", "a"), ("a", "o", None), ("d", "o", None), ("t", "o", "s"), ("u", "o", None), ("e", "p", None), ("b", "o", None), ("c", "o", "b")]
    assert sorted(held, key=str) == sorted(want, key=str)
