"""Queries of corpus ingest and hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import access, answers, cells, chunking, index, retrieval
from tidemark.operators import postings as postings_store
from tidemark.operators.bounds import small
from tidemark.plans import hybrid, ingest
from tidemark.plans import standins as st
from tidemark.sources.shared import save, shared_dir

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WITH_CHUNKS = f"WITH RECURSIVE {st.DOCUMENTS_SQL}, {st.CHUNKS_SQL}"
SEARCHED = (
    f"{WITH_CHUNKS}, searched AS (SELECT c.* FROM chunks c JOIN docs d ON c.source_id = d.id"
    f" WHERE d.status = 'completed' AND NOT d.is_deleted), {st.QUESTIONS_SQL}"
)
HYBRID = f"WITH {st.HYBRID_SQL}"


@query(
    SEARCHED
    + """ SELECT query_id, rank, chunk_id, source_id, section, keyword_score, substr(content, 1, 300) AS excerpt
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS rank FROM keyword_pool)
    JOIN searched USING (chunk_id) WHERE rank <= 8"""
)
def keyword_search(spark, sf_dir):
    """Only live documents are chunked, as if their chunks had been stored."""
    return hybrid.keyword_search(st.questions(spark, sf_dir), st.chunks(spark, sf_dir, st.live(spark, sf_dir)))


@query(WITH_CHUNKS + " SELECT source_id, organization_id, page, chunk_index, section, content, token_count FROM chunks")
def chunk_pages(spark, sf_dir):
    return st.chunks(spark, sf_dir).select(
        "source_id", "organization_id", "page", "chunk_index", "section", "content", "token_count"
    )


@query(
    WITH_CHUNKS
    + """ SELECT organization_id, term, chunk_id, count(*) AS tf
    FROM (SELECT organization_id, chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS term FROM chunks) GROUP BY ALL"""
)
def postings(spark, sf_dir):
    return index.postings(st.chunks(spark, sf_dir))


@query(
    f"{WITH_CHUNKS}, {st.LESSONS_SQL}"
    + """ SELECT chunk_id FROM chunks JOIN docs ON source_id = docs.id WHERE status = 'completed' AND NOT is_deleted
    UNION ALL SELECT id * 100000 FROM lessons WHERE lower(status) = 'published' AND NOT is_deleted"""
)
def eligible_chunks(spark, sf_dir):
    """Chunks of documents and of lessons."""
    return index.eligible_chunks(_all_chunks(spark, sf_dir), st.live(spark, sf_dir)).select("chunk_id")


@query(
    f"{WITH_CHUNKS}, {st.LESSONS_SQL}"
    + """ SELECT chunk_id FROM chunks JOIN docs ON source_id = docs.id WHERE NOT (status = 'completed' AND NOT is_deleted)
    UNION ALL SELECT id * 100000 FROM lessons WHERE NOT (lower(status) = 'published' AND NOT is_deleted)"""
)
def orphan_chunks(spark, sf_dir):
    return index.orphan_chunks(_all_chunks(spark, sf_dir), st.live(spark, sf_dir)).select("chunk_id")


def _all_chunks(spark, sf_dir):
    return st.chunks(spark, sf_dir).select("source_type", "source_id", "chunk_id").unionByName(st.lesson_chunks(spark, sf_dir))


@query(
    WITH_CHUNKS
    + """ SELECT chunk_id, CASE WHEN d.lang = 'fr' THEN 2 ELSE 1 END AS source_version
    FROM chunks JOIN docs d ON source_id = d.id WHERE d.lang <> 'de'"""
)
def replace_index(spark, sf_dir):
    """German sources give no new chunks and so leave; French ones get a new version."""
    chunks = st.chunks(spark, sf_dir).withColumn("lang", F.substring_index("source_title", "-", 1))
    old = chunks.withColumn("source_version", F.lit(1))
    fresh = chunks.filter("lang = 'fr'").withColumn("source_version", F.lit(2))
    gone = chunks.filter("lang IN ('fr', 'de')")
    return index.replace_index(old, fresh, gone).select("chunk_id", "source_version")


@query(
    """WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents),
    s AS (SELECT source, h, min(doc_id) AS stored FROM d WHERE doc_id % 5 = 1 AND doc_id % 17 <> 0 GROUP BY ALL),
    m AS (SELECT *, min(doc_id) OVER (PARTITION BY source, h) AS f FROM d WHERE doc_id % 5 <> 1)
    SELECT doc_id AS id, source AS organization_id, h AS sha256, coalesce(stored, CASE WHEN f <> doc_id THEN f END) AS existing_id
    FROM m LEFT JOIN s USING (source, h)"""
)
def duplicate_uploads(spark, sf_dir):
    """A fifth of the documents are stored, of them some deleted; the others are uploaded."""
    docs = st.documents(spark, sf_dir)
    rows = docs.select("id", "organization_id", tx.content_sha256(F.col("text")).alias("sha256"), "deleted_at")
    return index.duplicate_uploads(rows.filter("id % 5 <> 1").drop("deleted_at"), rows.filter("id % 5 = 1"))


@query(
    """WITH d AS (SELECT doc_id, source, sha256(text) AS h, coalesce(quality = 1, false) AS stored, doc_id % 17 = 0 AS gone
              FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT source, h, min(doc_id) AS f FROM d WHERE stored AND NOT gone GROUP BY ALL)
    SELECT doc_id AS id, coalesce(f, CASE WHEN doc_id <> e THEN e END) AS existing_id
    FROM (SELECT *, min(doc_id) OVER (PARTITION BY source, h) AS e FROM d WHERE NOT stored) LEFT JOIN s USING (source, h)"""
)
def duplicate_uploads_of_stored(spark, sf_dir):
    """Documents without a good label as uploads, those with one as stored."""
    docs = st.documents(spark, sf_dir)
    rows = docs.select("id", "organization_id", tx.content_sha256(F.col("text")).alias("sha256"), "deleted_at", "status")
    uploads = rows.filter("status <> 'completed'").select("id", "organization_id", "sha256")
    return index.duplicate_uploads(uploads, rows.filter("status = 'completed'")).select("id", "existing_id")


@query(
    WITH_CHUNKS
    + """ SELECT id, max(len(string_split(text, chr(10)))) AS page_count, count(source_id) AS chunk_count,
    bool_or(len(list_filter(string_split(text, chr(10)), lambda t: length(t) < 10)) > 0) AS ocr_used,
    CASE WHEN count(source_id) > 0 THEN 'completed' ELSE 'failed' END AS status
    FROM docs LEFT JOIN chunks ON source_id = id GROUP BY id"""
)
def ingest_summary(spark, sf_dir):
    return access.ingest_summary(st.documents(spark, sf_dir), st.pages(spark, sf_dir), st.chunks(spark, sf_dir))


@query(
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
       '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '\\s+', ' ', 'g')) AS text FROM pages"""
)
def strip_markup(spark, sf_dir):
    return st.table(spark, sf_dir, "pages").select("page_id", tx.strip_markup(F.col("html")).alias("text"))


@query(
    """WITH p AS (SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda t: length(trim(t))) AS n FROM documents)
    SELECT id, len(n) AS page_count, round(list_sum(n) / len(n), 6) AS mean_chars, list_sum(n) / len(n) < 20 AS needs_ocr FROM p"""
)
def scanned_documents(spark, sf_dir):
    found = access.scanned_documents(st.pages(spark, sf_dir), st.documents(spark, sf_dir))
    return found.withColumn("mean_chars", F.round("mean_chars", 6))


@query(
    """SELECT doc_id, p - 1 AS para,
         last_value(CASE WHEN regexp_matches(t, '^(#|Licensed|This|All)') THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) AS section
    FROM (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
)
def current_section(spark, sf_dir):
    """Licence lines stand for headings, which these texts lack."""
    lines = st.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "text"))
    heading = F.when(F.col("text").rlike("^(#|Licensed|This|All)"), F.col("text"))
    rows = lines.withColumn("page", F.lit(1)).withColumn("heading", heading)
    return chunking.current_section(rows, "doc_id").select("doc_id", F.col("para").cast("long").alias("para"), "section")


@query(
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(role), turn) - 1 AS chunk_index FROM conversations"""
)
def chunk_index(spark, sf_dir):
    """Roles by length stand for pages, turns for parts."""
    parts = st.table(spark, sf_dir, "conversations").select("conv_id", F.char_length("role").alias("page"), F.col("turn").alias("seq"))
    rows = chunking.chunk_index(parts, "conv_id")
    return rows.select("conv_id", F.col("seq").alias("turn"), F.col("chunk_index").cast("long").alias("chunk_index"))


@query(SEARCHED + " SELECT query_id, chunk_id, keyword_score FROM keyword_pool")
def keyword_candidates(spark, sf_dir):
    chunks = index.eligible_chunks(st.chunks(spark, sf_dir), st.live(spark, sf_dir))
    terms = save(retrieval.query_terms(st.questions(spark, sf_dir)), "terms")
    return retrieval.keyword_candidates(terms, index.postings(chunks, terms))


def _fused(spark, sf_dir, texts=None):
    asked = save(st.vector_questions(spark, sf_dir), "questions")
    return hybrid.fused(asked, st.vector_texts(spark, sf_dir) if texts is None else texts, st.vectors_alone(spark, sf_dir))


def _ranked(spark, sf_dir):
    """The ranked chunks, a few rows a question and stored, with what answers need of them:
    only then are texts looked up, and whatever uses the list twice reads what is stored."""
    texts = st.vector_texts(spark, sf_dir)
    ranked = save(retrieval.fused_topk(_fused(spark, sf_dir, texts)), "ranked")
    about = texts.select(
        "chunk_id", "content", F.lit("document").alias("source_type"), F.col("chunk_id").alias("source_id"),
        F.concat_ws("-", "lang", F.col("chunk_id").cast("string")).alias("source_title"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"),
    )
    return save(small(ranked, ranked.count(), 128).join(about, "chunk_id"), "ranked-texts")


@query(SEARCHED + " SELECT query_id, chunk_id, keyword_score FROM keyword_pool")
def keyword_candidates_stored(spark, sf_dir):
    """The same candidates from postings that are stored in blocks first, and then searched
    with bounds of their scores; a tenth of the chunks join them by an update."""
    chunks = save(st.chunks(spark, sf_dir, st.live(spark, sf_dir)), "chunks")
    table = postings_store.stored_postings(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}", 16)
    late = F.pmod(F.xxhash64("chunk_id"), F.lit(10)) == 0
    postings_store.write_postings(table, chunks.filter(~late))
    postings_store.update_postings(table, chunks.limit(0), chunks.filter(late))
    return postings_store.search_stored(retrieval.query_terms(st.questions(spark, sf_dir)), table)


@query(HYBRID + " SELECT query_id, chunk_id, vector_score FROM vector_pool")
def vector_candidates(spark, sf_dir):
    return retrieval.vector_candidates(st.vector_questions(spark, sf_dir), st.vector_rows(spark, sf_dir))


@query(
    """SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS vector_score
    FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY vector_score DESC, c.vec_id) <= 32"""
)
def vector_topk(spark, sf_dir):
    rows = st.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("organization_id"), "embedding"
    )
    asked = rows.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return retrieval.vector_candidates(asked, rows)


@query(SQL["vector_topk"])
def vector_topk_cells(spark, sf_dir):
    """The same nearest vectors, from cells of which those out of reach are skipped."""
    rows = st.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("organization_id"), "embedding"
    )
    asked = rows.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return cells.search_cells(asked, *cells.build_cells(rows))[0]


@query(HYBRID + " SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, chunk_id) - 1 AS rank0 FROM vector_pool")
def candidate_ranks(spark, sf_dir):
    ranks = retrieval.candidate_ranks(vector_candidates(spark, sf_dir), "vector_score")
    return ranks.select("query_id", "chunk_id", F.col("rank0").cast("long").alias("rank0"))


@query(HYBRID + " SELECT query_id, chunk_id, vector_score, keyword_score, round(fused_score, 9) AS fused_score FROM fused")
def fuse_candidates(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("fused_score", F.round("fused_score", 9))


@query(HYBRID + " SELECT query_id, chunk_id FROM fused WHERE vector_score >= 0.15 OR keyword_score > 0")
def score_floor(spark, sf_dir):
    return retrieval.score_floor(_fused(spark, sf_dir)).select("query_id", "chunk_id")


@query(HYBRID + " SELECT query_id, chunk_id, rank, round(fused_score, 9) AS fused_score FROM ranked")
def fused_topk(spark, sf_dir):
    ranked = retrieval.fused_topk(_fused(spark, sf_dir))
    return ranked.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("fused_score", 9).alias("fused_score"))


@query(HYBRID + " SELECT query_id, chunk_id, part_chars FROM used")
def context_budget(spark, sf_dir):
    used = answers.context_budget(_ranked(spark, sf_dir))
    return used.select("query_id", "chunk_id", F.col("part_chars").cast("long").alias("part_chars"))


@query(HYBRID + " SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_index FROM used")
def citation_index(spark, sf_dir):
    used = answers.citation_index(answers.context_budget(_ranked(spark, sf_dir)))
    return used.select("query_id", "chunk_id", F.col("citation_index").cast("long").alias("citation_index"))


@query(
    HYBRID
    + """ SELECT query_id, string_agg(chunk_id || ':' || round(greatest(vector_score, 0), 3)::DOUBLE, ',' ORDER BY rank) AS citations
    FROM ranked GROUP BY query_id"""
)
def citation_records(spark, sf_dir):
    """The JSON records, read back to one line a question."""
    rows = answers.citation_records(_ranked(spark, sf_dir))
    parsed = F.from_json("citations", "array<struct<chunkId:long,relevanceScore:double>>")
    line = F.transform(parsed, lambda r: F.concat_ws(":", r["chunkId"].cast("string"), r["relevanceScore"].cast("string")))
    return rows.select("query_id", F.array_join(line, ",").alias("citations"))


@query(
    HYBRID
    + """ SELECT query_id, 'منابع:' || chr(10) ||
      string_agg(rank || '. ' || source_title || chr(10) || '   صفحه 1', chr(10) ORDER BY rank) AS citation_text
    FROM ranked GROUP BY query_id"""
)
def citation_text(spark, sf_dir):
    return answers.citation_text(st.vector_questions(spark, sf_dir), _ranked(spark, sf_dir))


@query(
    HYBRID
    + """ SELECT query_id, 'بر اساس منبع: «' || source_title || '»:' || chr(10) || chr(10) || substr(content, 1, 600) || chr(10) || chr(10) ||
      '(توجه: مدل هوش مصنوعی محلی در دسترس نیست. این پاسخ مستقیماً از متن منابع استخراج شده است.)' AS answer,
      round(fused_score, 9) AS confidence FROM ranked WHERE rank = 1"""
)
def extractive_answer(spark, sf_dir):
    used = answers.context_budget(_ranked(spark, sf_dir))
    rows = answers.extractive_answer(st.vector_questions(spark, sf_dir), used)
    return rows.withColumn("confidence", F.round("confidence", 9))


@query(
    HYBRID
    + """ SELECT query_id, retrieved_count, used_count, top_scores, context_chars FROM
    (SELECT query_id, count(*) AS retrieved_count, string_agg(round(fused_score, 6)::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 5) AS top_scores FROM ranked GROUP BY query_id)
    JOIN (SELECT query_id, count(*) AS used_count, (sum(part_chars) + 7 * (count(*) - 1))::BIGINT AS context_chars FROM used GROUP BY query_id) USING (query_id)"""
)
def retrieval_trace(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    rows = answers.retrieval_trace(st.vector_questions(spark, sf_dir), ranked, answers.context_budget(ranked))
    scores = F.array_join(F.transform("top_scores", lambda s: F.round(s, 6).cast("string")), ",")
    return rows.withColumn("top_scores", scores)


@query(
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], f), 9) AS similarity
    FROM embeddings CROSS JOIN (SELECT embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id = 0)"""
)
def cosine_similarity(spark, sf_dir):
    """Every vector against vector 0: one row, joined to all."""
    rows = st.table(spark, sf_dir, "embeddings")
    first = rows.filter("vec_id = 0").select(F.col("embedding").alias("first"))
    joined = rows.join(F.broadcast(first))
    return joined.select("vec_id", F.round(vx.cosine_similarity(F.col("embedding"), F.col("first")), 9).alias("similarity"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM conversations)
    SELECT DISTINCT t AS token, list_reduce(list_transform(string_split(t, ''), lambda c: unicode(c)::BIGINT),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS hash FROM w WHERE length(t) > 0"""
)
def fnv1a32(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    tokens = st.table(spark, sf_dir, "conversations").select(F.explode(words).alias("token")).distinct()
    return tokens.select("token", vx.fnv1a32(F.col("token")).alias("hash"))


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS_FA + tx.STOPWORDS_EN)
TOKENS_SQL = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1 AND NOT list_contains([{STOP}], t))"


@query(f"SELECT conv_id, turn, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM conversations")
def tokenize(spark, sf_dir):
    """Exact where NFKC changes nothing, as in these texts."""
    rows = st.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(tx.tokenize(F.col("text")), " ").alias("tokens"))


@query(
    rf"""WITH t AS (SELECT conv_id, turn, {TOKENS_SQL} AS t FROM conversations),
    f AS (SELECT conv_id, turn, unnest(list_concat(list_transform(t, lambda x: {{'f': x, 'w': 1.0::DOUBLE}}),
            list_transform(range(1, len(t)), lambda i: {{'f': t[i] || '_' || t[i + 1], 'w': 0.5::DOUBLE}}))) AS u FROM t),
    h AS (SELECT conv_id, turn, u.w AS w, list_reduce(list_transform(string_split(u.f, ''), lambda c: unicode(c)::BIGINT),
            lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM f),
    v AS (SELECT conv_id, turn, h % 64 AS dimension, sum(CASE WHEN h % 2 = 1 THEN w ELSE -w END) AS x FROM h GROUP BY ALL)
    SELECT conv_id, turn, dimension, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 9) AS weight FROM v WHERE x <> 0"""
)
def hash_embedding(spark, sf_dir):
    """The non-zero weights of 64-dimensional embeddings of all messages."""
    rows = st.table(spark, sf_dir, "conversations")
    vectors = rows.select("conv_id", "turn", vx.hash_embedding(tx.tokenize(F.col("text")), 64, "double").alias("v"))
    weights = vectors.select("conv_id", "turn", F.posexplode("v").alias("dimension", "weight")).filter("weight <> 0")
    return weights.select("conv_id", "turn", F.col("dimension").cast("long").alias("dimension"), F.round("weight", 9).alias("weight"))


@query(
    rf"""WITH t AS (SELECT conv_id, turn, role, {TOKENS_SQL} AS t FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) = 0 OR len(q.t) = 0 THEN 0 ELSE len(list_filter(q.t, lambda x: list_contains(a.t, x))) / sqrt(len(a.t)) END, 9) AS score
    FROM t a JOIN t q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'"""
)
def lexical_score(spark, sf_dir):
    """Each answer against the message before it."""
    rows = st.table(spark, sf_dir, "conversations").withColumn("tokens", tx.tokenize(F.col("text")))
    asked = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("asked"))
    both = rows.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(vx.lexical_score(F.col("asked"), F.col("tokens")), 9).alias("score"))


@query(
    """WITH u AS (SELECT doc_id::VARCHAR AS id, source AS org, sha256(text) AS h, text,
      CASE WHEN doc_id % 10 = 3 THEN 'bad_ext' WHEN strlen(text) = 0 THEN 'empty' END AS reason FROM documents WHERE doc_id % 5 <> 1),
    s AS (SELECT source AS org, sha256(text) AS h, min(doc_id::VARCHAR) AS f FROM documents WHERE doc_id % 5 IN (1, 2) AND doc_id % 17 <> 0 GROUP BY ALL),
    g AS (SELECT id, nullif(coalesce(f, e), id) AS existing_id
      FROM (SELECT *, min(id) OVER (PARTITION BY org, h) AS e FROM u WHERE reason IS NULL) LEFT JOIN s USING (org, h)),
    o AS (SELECT *, reason IS NULL AND existing_id IS NULL AS fresh, trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS filled FROM u LEFT JOIN g USING (id))
    SELECT id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN existing_id IS NOT NULL THEN 'duplicate' WHEN filled THEN 'completed' ELSE 'failed' END AS status,
      reason, existing_id, NULL::BIGINT AS page_count, CASE WHEN fresh THEN filled::BIGINT END AS chunk_count FROM o"""
)
def ingest_files(spark, sf_dir):
    """Documents as uploaded files, a tenth of them of a forbidden kind; two fifths are stored,
    of which one half comes again."""
    docs = st.documents(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8"))
    extension = F.when(F.col("id") % 10 == 3, ".exe").otherwise(".txt")
    rows = docs.select(
        F.col("id").alias("number"), F.col("id").cast("string").alias("id"), "organization_id", F.concat("title", extension).alias("file_name"),
        F.octet_length("text").cast("long").alias("length"), "content", "deleted_at", F.sha2("content", 256).alias("sha256"),
    )
    stored = rows.filter("number % 5 IN (1, 2)").select("id", "organization_id", "sha256", "deleted_at")
    uploads = rows.filter("number % 5 <> 1").select("id", "organization_id", "file_name", "length", "content")
    return ingest.ingest_files(uploads, stored)[0].drop("organization_id", "sha256")
