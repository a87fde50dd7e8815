"""The given tables in the roles of the knowledge base's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunking, index
from tidemark.operators.bounds import small
from tidemark.sources.shared import save

#: Number of sources of documents, named src0 and so on.
ORGANIZATIONS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with status and deletion from their labels; the source is the tenant."""
    labels = table(spark, sf_dir, "labels")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").otherwise("pending")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("organization_id"),
        F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("title"),
        "text",
        "lang",
        status.alias("status"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_deleted"),
        F.when(F.col("doc_id") % 17 == 0, F.to_timestamp(F.lit("2024-01-10 00:00:00"))).alias("deleted_at"),
    )


DOCUMENTS_SQL = """docs AS (
  SELECT doc_id AS id, source AS organization_id, lang || '-' || doc_id AS title, text, lang,
         CASE quality WHEN 1 THEN 'completed' WHEN 0 THEN 'failed' ELSE 'pending' END AS status,
         coalesce(toxic = 1, false) AS is_deleted, doc_id % 17 = 0 AS listed_as_deleted
  FROM documents LEFT JOIN labels USING (doc_id))"""


def chunks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Chunks of all documents, or of the only sources given; as their texts have single
    newlines, these part paragraphs."""
    docs = documents(spark, sf_dir)
    if only is not None:
        docs = docs.join(only.select(F.col("source_id").alias("id")), "id", "left_semi")
    docs = docs.select(
        F.col("id").alias("source_id"), "organization_id", F.col("title").alias("source_title"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    rows = chunking.chunk_documents(docs, ["source_id", "organization_id", "source_title"])
    return rows.withColumn("source_type", F.lit("document")).withColumn(
        "chunk_id", F.col("source_id") * 100_000 + F.col("chunk_index")
    )


# paragraph by paragraph: what is open, the section, and the chunk closed in this step
CHUNKS_SQL = r"""paras AS (
  SELECT id, organization_id, title,
         list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(
           replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(10) || chr(10)),
           '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), chr(10) || chr(10)),
           lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS p
  FROM docs),
headed AS (
  SELECT *, list_transform(p, lambda x: CASE
      WHEN length(trim(x)) BETWEEN 1 AND 120 AND (regexp_matches(trim(x), '^#{1,6}\s') OR regexp_matches(trim(x), '^[0-9]+[.)]\s')
           OR (trim(x) = upper(trim(x)) AND regexp_matches(trim(x), '[A-Za-z]')))
      THEN regexp_replace(trim(x), '^#{1,6}\s', '') END) AS h
  FROM paras WHERE len(p) > 0),
steps AS (
  SELECT id, 0::BIGINT AS k, '' AS open, NULL::VARCHAR AS section, NULL::VARCHAR AS closed FROM headed
  UNION ALL
  SELECT s.id, k + 1,
         CASE WHEN k >= len(p) THEN ''
              WHEN length(open) + 2 + length(p[k + 1]) > 800
              THEN CASE WHEN open = '' THEN p[k + 1] ELSE right(open, 120) || chr(10) || chr(10) || p[k + 1] END
              WHEN open = '' THEN p[k + 1] ELSE open || chr(10) || chr(10) || p[k + 1] END,
         coalesce(h[k + 1], section),
         CASE WHEN trim(open) <> '' AND (k >= len(p) OR length(open) + 2 + length(p[k + 1]) > 800) THEN open END
  FROM steps s JOIN headed d ON s.id = d.id WHERE k <= len(p)),
chunks AS (
  SELECT d.id AS source_id, organization_id, title AS source_title, section, 1 AS page,
         (row_number() OVER (PARTITION BY d.id ORDER BY k) - 1)::INTEGER AS chunk_index,
         trim(closed, ' ' || chr(10)) AS content, ceil(length(closed) / 3)::INTEGER AS token_count,
         d.id * 100000 + row_number() OVER (PARTITION BY d.id ORDER BY k) - 1 AS chunk_id
  FROM steps JOIN headed d ON steps.id = d.id WHERE closed IS NOT NULL)"""


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, q, a): each question of a conversation with the answer that follows."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    said = rows.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return asked.join(said, ["conv_id", "turn"]).filter("q <> '' AND a <> ''")


EXCHANGES_SQL = """(SELECT u.conv_id, u.turn, u.text AS q, s.text AS a FROM conversations u JOIN conversations s
  ON u.conv_id = s.conv_id AND s.turn = u.turn + 1 WHERE u.role = 'user' AND s.role = 'assistant' AND u.text <> '' AND s.text <> '')"""


def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges of conversations as lessons: question and answer as problem and action; ids
    are negative, so that none is a document's."""
    number = F.col("conv_id")
    status = F.element_at(F.array(*map(F.lit, ("PUBLISHED", "published", "APPROVED", "DRAFT"))), (number % 4 + 1).cast("int"))
    return exchanges(spark, sf_dir).select(
        (-(number * 100_000 + F.col("turn")) - 1).alias("id"), F.concat(F.lit("src"), (number % ORGANIZATIONS).cast("string")).alias("organization_id"),
        F.col("q").alias("title"), F.col("q").alias("problem_description"), F.col("a").alias("actions_taken"),
        F.col("a").alias("lessons_learned"), F.array(F.lit("chat")).alias("tags"),
        status.alias("status"), (number % 9 == 0).alias("is_deleted"),
    )


LESSONS_SQL = f"""lessons AS (
  SELECT -(conv_id * 100000 + turn) - 1 AS id, 'src' || conv_id % 20 AS organization_id, q, a,
         ['PUBLISHED', 'published', 'APPROVED', 'DRAFT'][conv_id % 4 + 1] AS status, conv_id % 9 = 0 AS is_deleted
  FROM {EXCHANGES_SQL})"""


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lessons(spark, sf_dir).select("id", "status", "is_deleted")


def lesson_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk of each lesson, with the columns of an index that matter."""
    return lessons(spark, sf_dir).select(F.lit("experience").alias("source_type"), F.col("id").alias("source_id"), (F.col("id") * 100_000).alias("chunk_id"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a page; short ones count as recognised in a picture."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("source_id", (F.col("line") + 1).alias("page"), "text", (F.char_length("text") < 10).alias("ocr_used"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.live_sources(documents(spark, sf_dir), experiences(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, asked in one of all organisations."""
    organization = F.concat(F.lit("src"), (F.col("item_id") % ORGANIZATIONS).cast("string"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), organization.alias("organization_id"), "text")


QUESTIONS_SQL = r"""questions AS (
  SELECT item_id AS query_id, 'src' || item_id % 20 AS organization_id, text
  FROM benchmark),
terms AS (
  SELECT query_id, organization_id, len(t) AS n_terms, unnest(t) AS term
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(array_to_string(list_filter(
               string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: length(x) > 1)[1:12], ' ')),
               '[\p{L}\p{N}_]+')) AS t FROM questions)),
postings AS (
  SELECT organization_id, chunk_id, term, count(*) AS tf
  FROM (SELECT organization_id, chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS term FROM searched)
  GROUP BY ALL),
keyword_scored AS (
  SELECT query_id, chunk_id,
         round(0.1 / 1.64493406685 * sum(list_sum(list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))) / max(n_terms), 9) AS keyword_score
  FROM terms JOIN postings USING (organization_id, term) GROUP BY ALL),
keyword_pool AS (
  SELECT * FROM keyword_scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) <= 32)"""


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector: whole texts as chunks, the vector's label as tenant."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("organization_id"), "embedding"
    )
    return docs.join(vectors, "chunk_id")


def vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_rows without their vectors, stored: few enough ids go to the texts, which are
    then not shuffled."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang")
    owners = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("organization_id"))
    return save(docs.join(small(owners, owners.count(), 40), "chunk_id"), "vector-texts")


def vectors_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_rows without their texts."""
    return vector_rows(spark, sf_dir).select("chunk_id", "organization_id", "embedding")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100."""
    rows = vector_rows(spark, sf_dir).filter("chunk_id % 100 = 0")
    return rows.select(F.col("chunk_id").alias("query_id"), "organization_id", F.col("content").alias("text"), "embedding")


HYBRID_SQL = (
    """searched AS (
  SELECT doc_id AS chunk_id, label::VARCHAR AS organization_id, text AS content, lang, embedding::DOUBLE[] AS embedding
  FROM documents JOIN embeddings ON doc_id = vec_id),
"""
    + QUESTIONS_SQL.replace(
        """SELECT item_id AS query_id, 'src' || item_id % 20 AS organization_id, text
  FROM benchmark""",
        "SELECT chunk_id AS query_id, organization_id, content AS text, embedding FROM searched WHERE chunk_id % 100 = 0",
    )
    + """,
vector_pool AS (
  SELECT query_id, chunk_id, round(list_cosine_similarity(q.embedding, c.embedding), 9) AS vector_score
  FROM questions q JOIN searched c USING (organization_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) <= 32),
fused AS (
  SELECT query_id, chunk_id, coalesce(vector_score, 0) AS vector_score, coalesce(keyword_score, 0) AS keyword_score,
         coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + k.r), 0) AS fused_score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) AS r FROM vector_pool) v
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS r FROM keyword_pool) k
  USING (query_id, chunk_id)),
ranked AS (
  SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) AS rank, content, lang,
         lang || '-' || chunk_id AS source_title
  FROM fused f JOIN searched USING (chunk_id) WHERE vector_score >= 0.15 OR keyword_score > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) <= 8),
parts AS (
  SELECT *, '[منبع ' || rank || '] ' || source_title || chr(10) || substr(content, 1, 1200) AS part FROM ranked),
used AS (
  SELECT *, length(part) AS part_chars FROM parts
  QUALIFY sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) <= 8000 OR rank = 1)"""
)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: the user is the key, the event type the action."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("action"), "ts", F.col("event_id").alias("id")
    )


#: Longer windows than the production limits, so that denials happen in these events.
TEST_LIMITS = {"click": (3, 3 * 24 * 60), "view": (5, 10 * 24 * 60), "default": (2, 5 * 24 * 60)}
AS_OF = "2024-01-30 12:00:00"
EVENT_CODES = {"error": "FAILED_LOGIN", "signup": "LOGIN", "view": "DOCUMENT_VIEW", "click": "CHAT_MESSAGE", "purchase": "DOCUMENT_UPLOAD"}


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_CODES.items() for x in kv)), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 5).alias("organization_id"),
        F.col("user_id").alias("actor_id"),
        F.concat(F.lit("user"), F.col("user_id")).alias("actor_name"),
        code.alias("event_code"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("doc"), F.floor("value").cast("string"))).alias("resource_name"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("created_at"),
    )


AUDIT_SQL = """audit AS (
  SELECT event_id AS id, user_id % 5 AS organization_id, user_id AS actor_id, 'user' || user_id AS actor_name,
         CASE event_type WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'signup' THEN 'LOGIN' WHEN 'view' THEN 'DOCUMENT_VIEW'
              WHEN 'click' THEN 'CHAT_MESSAGE' WHEN 'purchase' THEN 'DOCUMENT_UPLOAD' END AS event_code,
         CASE WHEN event_type = 'view' THEN 'doc' || floor(value)::BIGINT END AS resource_name,
         props AS metadata, ts AS created_at FROM events)"""

# ---- people: customers are users, nations departments, regions organisations ----
ROLES = ("SUPER_ADMIN", "ORG_ADMIN", "DEPARTMENT_MANAGER", "REVIEWER", "EMPLOYEE")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("department_id"), F.col("n_regionkey").alias("organization_id"))
    rank = F.element_at(F.array(F.lit("member"), F.lit("manager"), F.lit("admin"), F.lit("guest")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("department_id")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
        F.concat(F.lit("u"), F.col("c_custkey")).alias("username"),
        "department_id",
        "organization_id",
        rank.alias("role"),
        (F.col("c_custkey") % 97 == 0).alias("is_superadmin"),
        (F.col("c_custkey") % 7 != 0).alias("is_active"),
        F.when(F.col("c_custkey") % 11 == 0, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("locked_until"),
    )


USERS_SQL = """users AS (
  SELECT c_custkey AS id, c_name AS name, 'u' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email,
         'u' || c_custkey AS username, n_nationkey AS department_id, n_regionkey AS organization_id,
         ['member', 'manager', 'admin', 'guest'][c_custkey % 4 + 1] AS role, c_custkey % 97 = 0 AS is_superadmin,
         c_custkey % 7 <> 0 AS is_active,
         CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS locked_until
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
roles AS (SELECT * FROM (VALUES (1, 'SUPER_ADMIN'), (2, 'ORG_ADMIN'), (3, 'DEPARTMENT_MANAGER'), (4, 'REVIEWER'), (5, 'EMPLOYEE')) t(id, name)),
user_roles AS (
  SELECT o_custkey AS user_id, (o_orderkey % 5 + 1)::INTEGER AS role_id, max(o_orderdate) AS created_at
  FROM orders WHERE o_orderkey % 5 + 1 <> 1 GROUP BY ALL),
permissions AS (
  SELECT row_number() OVER (ORDER BY code) AS id, code
  FROM (SELECT DISTINCT lower(l_returnflag) || '.' || lower(l_linestatus) || '.' || l_linenumber AS code FROM lineitem)),
role_permissions AS (SELECT r.id AS role_id, p.id AS permission_id FROM roles r JOIN permissions p ON p.id % (r.id + 1) = 0)"""


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(ROLES)], "id int, name string")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("role_id"), F.col("o_orderdate").alias("created_at")
    )
    return rows.filter("role_id <> 1").groupBy("user_id", "role_id").agg(F.max("created_at").alias("created_at"))


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from the flags of line items, a few dozen."""
    from pyspark.sql import Window

    code = F.concat_ws(".", F.lower("l_returnflag"), F.lower("l_linestatus"), F.col("l_linenumber").cast("string"))
    flags = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
    codes = flags.select(code.alias("code")).distinct()
    return codes.withColumn("id", F.row_number().over(Window.orderBy("code")).cast("long"))


def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = roles(spark, sf_dir).select(F.col("id").alias("role_id"))
    ids = permissions(spark, sf_dir).select(F.col("id").alias("permission_id"))
    return each.join(ids, F.col("permission_id") % (F.col("role_id") + 1) == 0)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("PROCESSING")
    return table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").alias("organization_id"),
        status.alias("status"),
        (F.col("o_orderkey") % 4).alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.col("o_orderdate").alias("created_at"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS id, c_nationkey AS organization_id,
         CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'FAILED' ELSE 'PROCESSING' END AS status,
         o_orderkey % 4 AS retry_count, 3 AS max_retries, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"),
        F.col("turn").alias("id"), F.col("turn").alias("created_at"),
    )
