"""Queries of column functions, filters and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import answers, filters
from tidemark.plans import standins as st

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def normalize_query(spark, sf_dir):
    return st.table(spark, sf_dir, "benchmark").select("item_id", tx.normalize_query(F.col("text")).alias("text"))


@query("""SELECT doc_id, trim(regexp_replace(translate(text, 'يكۀة' || chr(8204) || chr(8207) || chr(8206), 'یکهه   '), '\\s+', ' ', 'g')) AS text FROM documents""")
def normalize_persian(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_persian(F.col("text")).alias("text"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(html, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'),
       '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS html FROM pages"""
)
def normalize_whitespace(spark, sf_dir):
    return st.table(spark, sf_dir, "pages").select("page_id", tx.normalize_whitespace(F.col("html")).alias("html"))


@query(
    """SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 1)[1:12], '|') AS terms
    FROM benchmark"""
)
def or_terms(spark, sf_dir):
    return st.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.or_terms(F.col("text")), "|").alias("terms"))


@query("SELECT doc_id, ceil(length(text) / 3)::INTEGER AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    r"""SELECT DISTINCT t AS line, CASE WHEN length(trim(t)) BETWEEN 1 AND 120 AND (regexp_matches(trim(t), '^#{1,6}\s') OR regexp_matches(trim(t), '^[0-9]+[.)]\s')
      OR (trim(t) = upper(trim(t)) AND regexp_matches(trim(t), '[A-Za-z]'))) THEN regexp_replace(trim(t), '^#{1,6}\s', '') END AS heading
    FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM documents)"""
)
def detect_heading(spark, sf_dir):
    lines = st.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("line", tx.detect_heading(F.col("line")).alias("heading"))


@query("SELECT page_id, CASE WHEN contains(url, '.') THEN lower(string_split(url, '.')[-1]) ELSE '' END AS extension FROM pages")
def file_extension(spark, sf_dir):
    return st.table(spark, sf_dir, "pages").select("page_id", tx.file_extension(F.col("url")).alias("extension"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", tx.content_sha256(F.col("text")).alias("sha256"))


@query(
    """SELECT event_id, coalesce(nullif(trim(string_split(forwarded, ',')[1]), ''), nullif(real, '')) AS ip,
      coalesce(nullif(trim(string_split(forwarded, ',')[1]), ''), nullif(real, ''), 'unknown') || ':' || event_type AS key
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN ' 10.0.0.' || user_id || ' , 10.1.1.1' END AS forwarded,
                 CASE WHEN event_id % 2 = 0 THEN '10.2.2.' || user_id END AS real FROM events)"""
)
def client_ip(spark, sf_dir):
    """Addresses made from the users of events, by two headers."""
    e = st.table(spark, sf_dir, "events")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"), F.lit(" , 10.1.1.1")))
    ip = tx.client_ip(forwarded, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.2.2."), F.col("user_id"))))
    return e.select("event_id", ip.alias("ip"), tx.limiter_key(ip, F.col("event_type")).alias("key"))


@query(
    f"""SELECT conv_id, turn, 'عنوان: ' || q || chr(10) || chr(10) || 'مسئله (Problem): ' || q || chr(10) || chr(10) ||
      'اقدامات انجام‌شده (Actions Taken): ' || a || chr(10) || chr(10) || 'درس آموخته (Lesson Learned): ' || a ||
      chr(10) || chr(10) || 'برچسب‌ها: ' || 'user، assistant' AS text
    FROM {st.EXCHANGES_SQL}"""
)
def experience_text(spark, sf_dir):
    """Lessons made from conversations: each question as problem, its answer as action."""
    rows, fields = _lessons(spark, sf_dir)
    return rows.select("conv_id", "turn", tx.experience_text(fields, F.array(F.lit("user"), F.lit("assistant"))).alias("text"))


def _lessons(spark, sf_dir):
    fields = {
        "title": F.col("q"), "subject": F.lit(""), "problem_description": F.col("q"), "root_cause": F.lit(None).cast("string"),
        "actions_taken": F.col("a"), "lessons_learned": F.col("a"),
    }
    return st.exchanges(spark, sf_dir), fields


@query(
    f"""SELECT conv_id, turn, concat_ws(chr(10), q, q, a, a) AS at_first, concat_ws(chr(10) || chr(10), q, q, a, a) AS published
    FROM {st.EXCHANGES_SQL}"""
)
def experience_embedding_text(spark, sf_dir):
    rows, fields = _lessons(spark, sf_dir)
    text = tx.experience_embedding_text
    return rows.select("conv_id", "turn", text(fields, False).alias("at_first"), text(fields, True).alias("published"))


@query("SELECT doc_id, substr(text, 1, 300) AS excerpt, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS short FROM documents")
def excerpt_and_truncate(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select(
        "doc_id", tx.excerpt(F.col("text")).alias("excerpt"), tx.truncate(F.col("text"), 200).alias("short")
    )


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.15 WHEN event_id % 4 = 1 THEN value ELSE 0.15 END::DOUBLE AS setting FROM events")
def typed_setting(spark, sf_dir):
    """JSON values made from events: a number, a quoted number, a word and a null."""
    e = st.table(spark, sf_dir, "events")
    n = F.col("event_id") % 4
    value = F.when(n == 1, F.col("value").cast("string")).when(n == 0, F.concat(F.lit('"'), F.col("value"), F.lit('"'))).when(n == 2, "true")
    return e.select("event_id", tx.typed_setting(value, 0.15).alias("setting"))


@query(
    """SELECT event_id, '{"actor":' || user_id || ',"kind":"' || event_type || '"' || CASE WHEN value > 50 THEN ',"note":"large"' ELSE '' END || '}' AS metadata,
      event_type AS kind, json_extract_string(props, '$.k')::BIGINT AS k FROM events"""
)
def event_metadata(spark, sf_dir):
    e = st.table(spark, sf_dir, "events")
    made = tx.event_metadata(actor=F.col("user_id"), kind=F.col("event_type"), note=F.when(F.col("value") > 50, F.lit("large")))
    return e.select(
        "event_id", made.alias("metadata"), tx.read_metadata(made, "kind").alias("kind"),
        tx.read_metadata(F.col("props"), "k").cast("long").alias("k"),
    )


@query(
    """SELECT o_orderkey, o_orderdate + INTERVAL 12 HOUR AS expires_at, o_orderdate + INTERVAL 15 MINUTE AS locked_until FROM orders"""
)
def time_bounds(spark, sf_dir):
    ts = F.col("o_orderdate")
    return st.table(spark, sf_dir, "orders").select(
        "o_orderkey", cal.expires_at(ts, 12).alias("expires_at"), cal.locked_until(ts).alias("locked_until")
    )


@query("SELECT event_id, to_timestamp(floor(epoch(ts) / 60) * 60)::TIMESTAMP AS window_start FROM events")
def window_start(spark, sf_dir):
    return st.table(spark, sf_dir, "events").select("event_id", cal.window_start(F.col("ts")).alias("window_start"))


@query(
    """SELECT o_orderkey, size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 1024 * 10 + 0.5) / 10)
      ELSE printf('%.1f MB', floor(size / 1048576 * 10 + 0.5) / 10) END AS label FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 10))::BIGINT AS size FROM orders)"""
)
def file_size_label(spark, sf_dir):
    size = F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 10)).cast("long")
    rows = st.table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"))
    return rows.withColumn("label", tx.file_size_label(F.col("size")))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 40 + floor(55 * (l_linenumber / 7) + 0.5) ELSE 10 + floor(85 * (l_linenumber / 7) + 0.5) END::INTEGER AS progress
    FROM lineitem"""
)
def ingest_progress(spark, sf_dir):
    """Line numbers of orders as chunks done, of seven."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "document").otherwise("experience")
    return st.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.ingest_progress(F.col("l_linenumber"), F.lit(7), kind).alias("progress")
    )


@query("SELECT item_id, 'query: ' || text AS query, 'passage: ' || text AS passage FROM benchmark")
def embedding_input(spark, sf_dir):
    t = F.col("text")
    return st.table(spark, sf_dir, "benchmark").select(
        "item_id", tx.embedding_input(t, "query").alias("query"), tx.embedding_input(t, "passage").alias("passage")
    )


@query(
    """SELECT c_custkey, id, regexp_matches(id, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$') AS valid
    FROM (SELECT c_custkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || CASE WHEN c_custkey % 3 = 0 THEN substr(m, 13, 4) ELSE '4' || substr(m, 14, 3) END
          || '-' || substr(m, 17, 4) || '-' || upper(substr(m, 21, 12)) AS id FROM (SELECT c_custkey, md5(c_name) AS m FROM customer))"""
)
def valid_uuid(spark, sf_dir):
    """Identifiers made from hashes of customers' names; some have the wrong version."""
    m = F.md5("c_name")
    version = F.when(F.col("c_custkey") % 3 == 0, F.substring(m, 13, 4)).otherwise(F.concat(F.lit("4"), F.substring(m, 14, 3)))
    made = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), version, F.substring(m, 17, 4), F.upper(F.substring(m, 21, 12)))
    rows = st.table(spark, sf_dir, "customer").select("c_custkey", made.alias("id"))
    return rows.withColumn("valid", tx.valid_uuid(F.col("id")))


# a table of the first days of years, joined to each day
JALALI_SQL = """j AS (
  SELECT *, CASE WHEN d < 186 THEN 1 + d // 31 ELSE 7 + (d - 186) // 30 END AS m, CASE WHEN d < 186 THEN d % 31 + 1 ELSE (d - 186) % 30 + 1 END AS dd
  FROM (SELECT *, (day - start)::BIGINT AS d FROM days
        ASOF JOIN (SELECT y + 1300 AS y, DATE '1921-03-21' + (365 * y + (8 * (y + 1300) + 21) // 33 - (8 * 1300 + 21) // 33)::INTEGER AS start FROM range(0, 200) t(y)) starts
        ON day >= start))"""


@query(
    f"""WITH days AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders UNION SELECT DISTINCT ts::DATE FROM events), {JALALI_SQL}
    SELECT day::VARCHAR AS day, y || '/' || lpad(m::VARCHAR, 2, '0') || '/' || lpad(dd::VARCHAR, 2, '0') AS jalali,
      translate(y || '/' || lpad(m::VARCHAR, 2, '0') || '/' || lpad(dd::VARCHAR, 2, '0'), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS persian,
      dd || ' ' || ['فروردین', 'اردیبهشت', 'خرداد', 'تیر', 'مرداد', 'شهریور', 'مهر', 'آبان', 'آذر', 'دی', 'بهمن', 'اسفند'][m] || ' ' || y AS long
    FROM j"""
)
def jalali_date(spark, sf_dir):
    days = st.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    days = days.union(st.table(spark, sf_dir, "events").select(F.to_date("ts"))).distinct()
    d = F.col("day")
    return days.select(
        d.cast("string").alias("day"), cal.jalali_date(d).alias("jalali"), cal.jalali_date_persian(d).alias("persian"), cal.jalali_long(d).alias("long")
    )


@query(
    f"""WITH days AS (SELECT event_id, ts, ts::DATE AS day FROM events), {JALALI_SQL},
    a AS (SELECT *, epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM j)
    SELECT event_id, CASE WHEN s < 60 THEN 'لحظاتی پیش' WHEN s < 3600 THEN s // 60 || ' دقیقه پیش' WHEN s < 86400 THEN s // 3600 || ' ساعت پیش'
      WHEN s < 2592000 THEN s // 86400 || ' روز پیش' ELSE y || '/' || lpad(m::VARCHAR, 2, '0') || '/' || lpad(dd::VARCHAR, 2, '0') END AS age,
      y || '/' || lpad(m::VARCHAR, 2, '0') || '/' || lpad(dd::VARCHAR, 2, '0') || strftime(ts, ' %H:%M') AS written FROM a"""
)
def age_label(spark, sf_dir):
    as_of = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    return st.table(spark, sf_dir, "events").select(
        "event_id", cal.age_label(F.col("ts"), as_of).alias("age"), cal.jalali_date_time(F.col("ts")).alias("written")
    )


@query(
    """SELECT s_suppkey, round(greatest(s_acctbal / 10000, 0)::DOUBLE, 3) AS citation_score, greatest(0, least(1, s_acctbal / 5000))::DOUBLE AS confidence FROM supplier"""
)
def citation_score(spark, sf_dir):
    return st.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        answers.citation_score(F.col("s_acctbal") / 10000).alias("citation_score"),
        answers.confidence(F.col("s_acctbal") / 5000).alias("confidence"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(0.1 / 1.64493406685 * list_sum(list_transform(range(1, l_linenumber + 1), lambda j: 1.0::DOUBLE / (j * j))) / 2, 9) AS keyword_rank,
      round(1.0::DOUBLE / (60 + l_linenumber), 9) AS rrf FROM lineitem"""
)
def rank_scores(spark, sf_dir):
    """Line numbers as term counts and as ranks."""
    n = F.col("l_linenumber")
    return st.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(vx.keyword_rank(vx.term_rank(n), F.lit(2)), 9).alias("keyword_rank"), F.round(vx.rrf(n - 1), 9).alias("rrf"),
    )


UPLOADS_SQL = """uploads AS (
  SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN '../' || p_name || '.pdf' WHEN 1 THEN p_name || '.exe' WHEN 2 THEN repeat(p_name, 30) || '.pdf'
         ELSE p_name || ['.PDF', '.docx', '.txt', ''][p_size % 4 + 1] END AS name,
         CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN (p_retailprice * 100000)::BIGINT ELSE p_partkey END AS size FROM part)"""


def _uploads(spark, sf_dir):
    """Parts as uploads: names with bad paths, endings and lengths, sizes of all kinds."""
    p = st.table(spark, sf_dir, "part")
    ending = F.element_at(F.array(*map(F.lit, (".PDF", ".docx", ".txt", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    n = F.col("p_size") % 7
    name = (
        F.when(n == 0, F.concat(F.lit("../"), "p_name", F.lit(".pdf")))
        .when(n == 1, F.concat("p_name", F.lit(".exe")))
        .when(n == 2, F.concat(F.repeat("p_name", 30), F.lit(".pdf")))
        .otherwise(F.concat(F.col("p_name"), ending))
    )
    k = F.col("p_partkey") % 5
    size = F.when(k == 0, 0).when(k == 1, F.round(F.col("p_retailprice") * 100000).cast("long")).otherwise(F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), size.alias("size"))


@query(
    f"""WITH {UPLOADS_SQL} SELECT id, CASE WHEN contains(name, '..') OR contains(name, '/') OR contains(name, '\\') THEN 'bad_name'
      WHEN length(name) > 260 THEN 'long_name'
      WHEN NOT list_contains(['pdf','docx','doc','xlsx','xls','pptx','txt','csv','md','rtf','odt','png','jpg','jpeg','tiff','bmp'],
        CASE WHEN contains(name, '.') THEN lower(string_split(name, '.')[-1]) ELSE '' END) THEN 'bad_ext'
      WHEN size <= 0 THEN 'empty' WHEN size > 52428800 THEN 'too_big' END AS problem FROM uploads"""
)
def validate_upload(spark, sf_dir):
    rows = _uploads(spark, sf_dir)
    return rows.select("id", filters.upload_problem(F.col("name"), F.col("size")).alias("problem"))


@query(
    """SELECT conv_id, turn, CASE WHEN text IS NULL OR length(text) NOT BETWEEN 1 AND 300 THEN 'content' ELSE '' END AS problems FROM conversations"""
)
def validate_messages(spark, sf_dir):
    """Messages against a bound that some of them pass."""
    rows = st.table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    problems = filters.violated_rules("message", rows, {"message": {"content": (1, 300)}})
    return rows.select("conv_id", "turn", F.array_join(problems, ",").alias("problems"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN length(substr(text, 1, 40 * (doc_id % 20))) NOT BETWEEN 2 AND 500 THEN 'title' END,
      CASE WHEN length(lang || text) > 255 THEN 'subject' END, CASE WHEN length(text) NOT BETWEEN 10 AND 5000 THEN 'problem_description' END,
      CASE WHEN doc_id % 3 > 0 AND length(text) > 2000 THEN 'root_cause' END, CASE WHEN length(text) NOT BETWEEN 10 AND 5000 THEN 'actions_taken' END,
      CASE WHEN length(text) > 2000 THEN 'results' END, CASE WHEN length(text) NOT BETWEEN 10 AND 3000 THEN 'lessons_learned' END,
      CASE WHEN length(text) > 2000 THEN 'suggestion' END, CASE WHEN length(text) > 500 THEN 'related_equipment' END,
      CASE WHEN length(text) > 500 THEN 'related_process' END,
      CASE WHEN doc_id % 6 = 4 THEN 'importance' END, CASE WHEN doc_id % 5 = 3 THEN 'visibility' END,
      CASE WHEN len(string_split(text, chr(10))) > 20 OR len(list_filter(string_split(text, chr(10)), lambda t: length(t) > 100)) > 0 THEN 'tags' END) AS problems FROM documents"""
)
def validate_records(spark, sf_dir):
    """Documents as lessons: the text or parts of it in all fields, lines as tags; some root
    causes, importances and visibilities are null, which is allowed."""
    text, number = F.col("text"), F.col("doc_id")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))
    whole = "problem_description actions_taken results lessons_learned suggestion related_equipment related_process"
    rows = st.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("substring(text, 1, cast(40 * (doc_id % 20) as int))").alias("title"), F.concat("lang", "text").alias("subject"),
        F.when(number % 3 > 0, text).alias("root_cause"), *(text.alias(name) for name in whole.split()),
        pick("LOW", "MEDIUM", "HIGH", "CRITICAL", "low", None).alias("importance"),
        pick("private", "department", "organization", "public", None).alias("visibility"), F.split("text", "\n").alias("tags"),
    )
    return rows.select("doc_id", F.array_join(filters.violated_rules("experience", rows), ",").alias("problems"))


@query(
    """SELECT doc_id, concat_ws(',', CASE WHEN length(text) NOT BETWEEN 2 AND 500 THEN 'title' END,
      CASE WHEN length(text) NOT BETWEEN 10 AND 10000 THEN 'content' END, CASE WHEN doc_id % 2 = 0 AND length(text) > 1000 THEN 'summary' END,
      CASE WHEN doc_id % 4 = 3 THEN 'visibility' END) AS problems FROM documents"""
)
def validate_knowledge(spark, sf_dir):
    """Documents as articles, without subject and tags."""
    visibility = F.element_at(F.array(*map(F.lit, ("private", "department", "organization", "PRIVATE"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = st.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("summary"),
        visibility.alias("visibility"), F.lit("none of its fields").alias("importance"),
    )
    return rows.select("doc_id", F.array_join(filters.violated_rules("knowledge", rows), ",").alias("problems"))
