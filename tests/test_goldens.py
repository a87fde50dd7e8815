"""Edge rules worked out by hand."""

import csv
import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import text as tx
from tidemark.functions import vectors as vx
from tidemark.operators import access, answers, chunking, filters, index, retrieval, workflow
from tidemark.sources import files, tables
from tidemark.streaming import replay


def each(spark, kind, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_text_rules(spark):
    s = lambda values, f: each(spark, "string", values, f)
    assert s(["كتاب‌علي"], tx.normalize_persian) == ["کتاب علی"]
    assert s(["a\r\n\r\n\r\nb \t c"], tx.normalize_whitespace) == ["a\n\nb c"]
    assert s(["a bb ccc"], tx.or_terms) == [["bb", "ccc"]]
    many = [f"{a}{b}" for a in "ab" for b in "abcdefgh"][:15]
    assert s([" ".join(many)], tx.or_terms) == [many[:12]]
    assert s(["<a>x</a>&amp;lt;"], tx.strip_markup) == ["x <"]
    assert s(["A.B.PDF", "noext"], tx.file_extension) == ["pdf", ""]
    assert s(["abcdef", "abc"], lambda c: tx.truncate(c, 5)) == ["ab...", "abc"]
    headings = ["## Plan", "3) Steps", "SAFETY", "123", "ماده ۵", "A" * 121]
    assert s(headings, tx.detect_heading) == ["Plan", "3) Steps", "SAFETY", None, "ماده ۵", None]
    assert s(["0.2", '"0.2"', None, "{}"], lambda c: tx.typed_setting(c, 0.15)) == [0.2, 0.15, 0.15, 0.15]
    assert s(["Ｐump the ﬁre ي", "the of"], tx.tokenize) == [["pump", "fire"], []]
    ips = s([" 1.2.3.4 , 5.6.7.8", None], lambda c: tx.client_ip(c, F.lit("9.9.9.9")))
    assert ips == ["1.2.3.4", "9.9.9.9"]
    assert each(spark, "long", [5, 2048, 5 << 20, 3 << 30], tx.file_size_label) == ["5 B", "2.0 KB", "5.0 MB", "3.0 GB"]


def test_hashes_and_vectors(spark):
    assert each(spark, "string", ["hello", "سلام", "été_the"], vx.fnv1a32) == [1335831723, 502922046, 3051276447]
    got = each(spark, "array<string>", [["pump", "failure"], []], lambda c: vx.hash_embedding(c, 768))
    assert {i: round(x, 6) for i, x in enumerate(got[0]) if x} == {118: -0.333333, 363: 0.666667, 561: 0.666667}
    assert not any(got[1])
    small = each(spark, "array<string>", [["pump", "failure"]], lambda c: vx.hash_embedding(c, 8))[0]
    assert {i: round(x, 6) for i, x in enumerate(small) if x} == {1: 0.666667, 3: 0.666667, 6: -0.333333}
    one = spark.sql("SELECT array(1f, 0f) a, array(1f, 1f) b, array(0f, 0f) z")
    row = one.select(vx.cosine_similarity(F.col("a"), F.col("b")).alias("x"), vx.cosine_similarity(F.col("a"), F.col("z")).alias("y")).first()
    assert round(row.x, 7) == 0.7071068 and row.y == 0
    words = spark.sql("SELECT array('a1', 'b1', 'a1') q, array('a1', 'c1', 'd1', 'e1') t")
    assert words.select(vx.lexical_score(F.col("q"), F.col("t")).alias("x")).first().x == 1.0
    ranks = each(spark, "int", [1, 2, 3], lambda c: vx.keyword_rank(vx.term_rank(c), F.lit(1)))
    assert [round(x, 7) for x in ranks] == [0.0607927, 0.0759909, 0.0827456]
    assert [round(x, 7) for x in each(spark, "int", [0, None], vx.rrf)] == [0.0163934, 0.0]


def test_jalali_dates(spark):
    days = "2024-01-01 2024-03-19 2024-03-20 2024-09-22 2025-03-20 2025-03-21 2000-02-29 1979-02-11".split()
    want = "1402/10/11 1402/12/29 1403/01/01 1403/07/01 1403/12/30 1404/01/01 1378/12/10 1357/11/22".split()
    dates = [dt.date.fromisoformat(d) for d in days] + [None]
    assert each(spark, "date", dates, cal.jalali_date) == [*want, ""]


PAGES = [("a", 1, "# Intro\n\naaaa bbbb cccc\n\n2. Scope\n\ndddd eeee"), ("a", 2, "ffff"), ("b", 1, " \n\n "), ("c", 1, None)]
CHUNKS = [
    (0, 1, "Intro", "# Intro", 3),
    (1, 1, "2. Scope", "Intro\n\naaaa bbbb cccc", 7),
    (2, 1, "2. Scope", "cccc\n\n2. Scope", 5),
    (3, 1, "2. Scope", "Scope\n\ndddd eeee", 6),
    (4, 2, "2. Scope", "ffff", 2),
]


def test_chunks(spark):
    df = spark.createDataFrame(PAGES, "source_id string, page int, text string")
    got = chunking.chunk_pages(df, ["source_id"], 20, 5).orderBy("chunk_index").collect()
    assert {r.source_id for r in got} == {"a"}
    assert [(r.chunk_index, r.page, r.section, r.content, r.token_count) for r in got] == CHUNKS


def test_chunk_properties(spark, sf_dir):
    """Every paragraph is in a chunk; a chunk begins with the end of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = chunking.chunk_documents(docs, ["doc_id"]).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk_index)):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in docs.select("doc_id", tx.normalize_whitespace(F.col("text")).alias("text")).collect():
        chunks = by_doc[doc.doc_id]
        assert [c.chunk_index for c in chunks] == list(range(len(chunks)))
        whole = "\n".join(c.content for c in chunks)
        assert all(p.strip() in whole for p in doc.text.split("\n\n") if p.strip())
        for a, b in zip(chunks, chunks[1:]):
            assert b.content.startswith(a.content[-120:].strip()[:60])


def test_uploads(spark):
    rows = [("../x.pdf", 1), ("x.exe", 1), ("x.pdf", 0), ("x.pdf", 52428801), ("x.pdf", 10), ("y" * 260 + ".pdf", 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, size long")
    got = [r.p for r in df.orderBy("i").select(filters.upload_problem(F.col("name"), F.col("size")).alias("p")).collect()]
    assert got == ["bad_name", "bad_ext", "empty", "too_big", None, "long_name"]


def test_score_floor(spark):
    rows = [(1, 0.15, 0.0), (2, 0.149, 0.0), (3, float("nan"), 0.0), (4, 0.0, 0.01)]
    df = spark.createDataFrame(rows, "i int, vector_score double, keyword_score double")
    assert sorted(r.i for r in retrieval.score_floor(df).collect()) == [1, 4]


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8)], "query_id long, chunk_id long, vector_score double")
    k = spark.createDataFrame([(1, 10, 0.5), (1, 12, 0.4), (2, 12, 0.3)], "query_id long, chunk_id long, keyword_score double")
    got = {(r.query_id, r.chunk_id): round(r.fused_score, 7) for r in retrieval.fuse_candidates(v, k).collect()}
    assert got == {(1, 10): 0.0327869, (1, 11): 0.016129, (1, 12): 0.016129, (2, 12): 0.0163934}


def test_context_budget_and_answers(spark):
    rows = [(1, i, i, "experience" if i == 2 else "document", f"t{i}", "x" * 1300, 1 if i < 3 else None, "s" if i == 1 else None, 0.5, 0.03) for i in range(1, 9)]
    kind = "query_id long, rank int, chunk_id long, source_type string, source_title string, content string, page int, section string, vector_score double, fused_score double"
    ranked = spark.createDataFrame(rows, kind).withColumn("source_id", F.col("chunk_id"))
    used = answers.context_budget(ranked)
    assert sorted(r.rank for r in used.collect()) == [1, 2, 3, 4, 5, 6]
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    trace = {r.query_id: r for r in answers.retrieval_trace(asked, ranked, used).collect()}
    assert (trace[1].retrieved_count, trace[1].used_count, len(trace[1].top_scores)) == (8, 6, 5)
    assert (trace[2].retrieved_count, trace[2].used_count, trace[2].top_scores, trace[2].context_chars) == (0, 0, [], 0)
    said = {r.query_id: r for r in answers.extractive_answer(asked, used).collect()}
    assert said[2].answer == answers.NO_ANSWER and said[2].confidence == 0 and "«t1»" in said[1].answer
    cited = {r.query_id: r.citation_text for r in answers.citation_text(asked, ranked).collect()}
    assert cited[2] == "" and cited[1].split("\n")[:3] == ["منابع:", "1. t1", "   صفحه 1"]
    huge = spark.createDataFrame([(1, 1, 1, "document", "t" * 9000, "x", None, None, 0.5, 0.03)], kind)
    assert answers.context_budget(huge).count() == 1


def test_needs_ocr(spark):
    pages = spark.createDataFrame([(1, "x" * 19), (1, "x" * 20), (2, "x" * 20), (2, " " + "x" * 20)], "source_id int, text string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert {r.id: r.needs_ocr for r in access.scanned_documents(pages, docs).collect()} == {1: True, 2: False, 3: True}


def test_rollup_counts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}" * 60) for t in range(6)]
    df = spark.createDataFrame(rows, "conversation_id int, turn long, role string, content string")
    row = access.conversation_rollup(df).first()
    assert row.message_count == 5 and row.title == ("m0" * 60)[:100]


def minutes(*values):
    return [dt.datetime(2024, 1, 1, 10, m) if m < 60 else None for m in values]


LOGIN = [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (15, False), (16, True)]


def test_sliding_limit(spark):
    rows = [("k", "login", t, i) for i, t in enumerate(minutes(*(m for m, _ in LOGIN)))]
    df = spark.createDataFrame(rows, "key string, action string, ts timestamp, id long")
    got = {r.id: r.allowed for r in replay.sliding_log_limit(df).collect()}
    assert [got[i] for i in range(len(LOGIN))] == [ok for _, ok in LOGIN]


LOCK = [(0, False), (1, False), (2, False), (3, False), (4, False), (10, True), (20, False), (30, True), (36, True)]
LOCKED = ["wrong_password"] * 5 + ["account_locked", "wrong_password", "account_locked", "success"]


def test_lockout(spark):
    rows = [(1, t, i, ok) for i, (t, (_, ok)) in enumerate(zip(minutes(*(m for m, _ in LOCK)), LOCK))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, id long, success boolean")
    users = spark.createDataFrame([(1, True)], "id long, is_active boolean")
    got = {r.id: r for r in replay.login_lockout(df, users).collect()}
    assert [got[i].outcome for i in range(len(LOCK))] == LOCKED
    assert got[6].failures == 6 and got[8].failures == 0
    nobody = replay.login_lockout(df, users.filter("false")).collect()
    assert {r.outcome for r in nobody} == {"user_not_found"}


def test_workflow(spark):
    targets = ["PUBLISHED", "UNDER_REVIEW", "APPROVED", "PUBLISHED", "DRAFT", "ARCHIVED"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(targets)], "item_id int, seq long, target string")
    got = workflow.knowledge_transitions(df).orderBy("seq").collect()
    assert [r.accepted for r in got] == [False, True, True, True, False, True] and got[-1].status == "ARCHIVED"


def test_workflow_of_a_hot_item(spark, capsys):
    """One item with most requests streams in order; no row holds them all."""
    order = ["UNDER_REVIEW", "DRAFT", "UNDER_REVIEW", "APPROVED", "PUBLISHED", "DRAFT", ""]
    data = [(item, i, order[(i * i + i // 3) % 7]) for item, n in ((2**60 + 1, 30_000), (None, 50), (2**60, 9)) for i in range(n)]
    df = spark.createDataFrame(data, "item_id long, seq long, target string").repartition(5)
    out = workflow.knowledge_transitions(df)
    out.explain()
    assert "collect_list" not in capsys.readouterr().out
    want, status = {}, {}
    for item, seq, target in data:
        now = status.get(item, "DRAFT")
        ok = now in workflow.ALLOWED_FROM.get(target, ())
        status[item] = target if ok else now
        if target:
            want[item, seq] = (target, ok, status[item])
    assert {(r.item_id, r.seq): (r.target, r.accepted, r.status) for r in out.collect()} == want


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, 0, 3)], "id int, retry_count int, max_retries int")
    for failures, status in ((1, "PENDING"), (2, "PENDING"), (3, "FAILED")):
        rows = spark.createDataFrame([(1,)] * failures, "job_id int")
        assert workflow.job_outcomes(jobs, rows).first().status == status


def test_table_changes(spark):
    df = lambda rows: spark.createDataFrame(rows, "key string, value int")
    got = index.insert_if_absent(df([("a", 0)]), df([("a", 1), ("b", 2), ("b", 3)]), ["key"], ["value"]).collect()
    assert sorted((r.key, r.value) for r in got) == [("a", 0), ("b", 2)]
    kind = "source_type string, source_id int, content string"
    old = spark.createDataFrame([("document", 1, "old"), ("document", 2, "stay")], kind)
    fresh = spark.createDataFrame([("document", 1, "new")], kind)
    once = index.replace_index(old, fresh)
    assert sorted(r.content for r in once.collect()) == ["new", "stay"]
    assert sorted(r.content for r in index.replace_index(once, fresh).collect()) == ["new", "stay"]


def test_permissions(spark):
    users = spark.createDataFrame([(1, True), (2, False)], "id int, is_superadmin boolean")
    grants = spark.createDataFrame([(2, 1)], "user_id int, role_id int")
    of_role = spark.createDataFrame([(1, 1), (1, 99)], "role_id int, permission_id int")
    codes = spark.createDataFrame([(1, "doc.read"), (2, "doc.write")], "id int, code string")
    held = access.effective_permissions(users, grants, of_role, codes)
    assert {(r.user_id, r.code) for r in held.collect()} == {(1, "doc.read"), (1, "doc.write"), (2, "doc.read")}
    asked = spark.createDataFrame([(1, ["doc.write"]), (2, ["doc.read", "x.y"]), (3, ["doc.read"])], "user_id int, codes array<string>")
    got = {r.user_id: (r.has_all, r.has_any) for r in access.check_permissions(held, asked).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False)}


@pytest.fixture
def stored(tmp_path):
    def archive(entries):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, data in entries:
                z.writestr(name, data)
        return raw.getvalue()

    slide = "<p:sld><a:t>slide {0}</a:t> &amp; more</p:sld>"
    made = {
        "a.txt": "plain é".encode(),
        "b.csv": b'x,"two\nlines",z\nragged\n',
        "c.pptx": archive([(f"ppt/slides/slide{n}.xml", slide.format(n)) for n in (10, 2, 1)] + [("ppt/other.xml", "no")]),
        "d.odt": archive([("content.xml", "<t>odt text</t>")]),
        "e.odt": archive([("other.xml", "x")]),
        "f.docx": b"not a zip",
        "g.docx": archive([(f"e{n}", "") for n in range(2001)]),
        "h.docx": archive([("ok", "x"), ("../x", "y")]),
    }
    folder = tmp_path / "org1" / "documents"
    folder.mkdir(parents=True)
    for name, raw in made.items():
        (folder / name).write_bytes(raw)
    return str(tmp_path), made


def test_files(spark, stored):
    root, made = stored
    found = files.read_files(spark, root)
    assert {(r.organization_id, r.category) for r in found.collect()} == {("org1", "documents")}
    named = found.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).withColumn("source_id", F.col("file_name"))
    of = lambda *names: named.filter(F.col("file_name").isin(*names))
    assert files.plain_text_pages(of("a.txt")).first().text == "plain é"
    text = files.csv_pages(of("b.csv")).first().text
    assert text == "x | two\nlines | z\nragged" and list(csv.reader(["a"]))
    pages = sorted((r.source_id, r.page, r.text) for r in files.office_pages(of("c.pptx", "d.odt", "e.odt")).collect())
    assert pages == [("c.pptx", 1, "slide 1 & more"), ("c.pptx", 2, "slide 2 & more"), ("c.pptx", 3, "slide 10 & more"), ("d.odt", 1, "odt text"), ("e.odt", 1, "")]
    problems = files.zip_stats(named).select("file_name", filters.zip_problem(F.col("stats")).alias("p")).collect()
    assert {r.file_name: r.p for r in problems if r.p} == {"f.docx": "corrupt", "g.docx": "too_many_entries", "h.docx": "bad_path"}


def test_audit_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 1)), (2, "FAILURE", dt.datetime(2024, 1, 2))], "id int, outcome string, created_at timestamp")
    path = str(tmp_path / "audit")
    tables.append_events(rows, path)
    tables.append_events(rows.filter("id = 2"), path)
    got = sorted((r.id, r.outcome, r.severity, r.metadata, str(r.date)) for r in tables.read_table(spark, path).collect())
    assert got == [(1, "SUCCESS", "INFO", "{}", "2024-01-01"), (2, "FAILURE", "INFO", "{}", "2024-01-02"), (2, "FAILURE", "INFO", "{}", "2024-01-02")]


def test_records(spark):
    """Bounds and lists of values of all fields; what is optional may be null or absent."""
    kind = "title string, problem_description string, root_cause string, actions_taken string, lessons_learned string, importance string, visibility string, tags array<string>"
    good = ("ok", "p" * 10, None, "a" * 10, "l" * 10, "HIGH", "organization", [])
    rows = [good, ("ok", "p" * 10, "r" * 2001, "a" * 10, "l" * 10, "high", "public", ["t"] * 21), (None, "p" * 9, "r", "a" * 5001, "l" * 3001, None, None, ["t" * 101])]
    df = spark.createDataFrame(rows, kind)
    got = [r.x for r in df.select(filters.violated_rules("experience", df).alias("x")).collect()]
    assert got[0] == [] and got[1] == ["root_cause", "importance", "visibility", "tags"]
    assert got[2] == ["title", "problem_description", "actions_taken", "lessons_learned", "tags"]
    article = spark.createDataFrame([("t", "c" * 10, "s" * 1001)], "title string, content string, summary string")
    assert article.select(filters.violated_rules("knowledge", article).alias("x")).first().x == ["title", "summary"]


def test_superadmins_pass_unlisted_codes(spark):
    users = spark.createDataFrame([(1, True), (2, False)], "id int, is_superadmin boolean")
    held = spark.createDataFrame([(2, "doc.read")], "user_id int, code string")
    asked = spark.createDataFrame([(1, ["no.such"]), (2, ["no.such", "doc.read"]), (3, ["doc.read"])], "user_id int, codes array<string>")
    got = {r.user_id: (r.has_all, r.has_any) for r in access.check_permissions(held, asked, users).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False)}
    assert [r.id for r in access.has_permission(users, held, "no.such").collect()] == [1]
    requests = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (None, "a"), (2, None)], "user_id int, target string")
    allowed = access.permitted_requests(requests, held, users, {"a": "doc.read", "b": "doc.write"}, "target").collect()
    assert {(r.user_id, r.target): r.permitted for r in allowed} == {(1, "a"): True, (2, "a"): True, (2, "b"): False, (None, "a"): False, (2, None): False}


def test_stored_duplicates(spark):
    incoming = spark.createDataFrame([(10, "o", "x"), (11, "o", "y"), (12, "o", "y"), (13, "p", "x")], "id int, organization_id string, sha256 string")
    stored = spark.createDataFrame([(1, "o", "x", None), (2, "o", "y", dt.datetime(2024, 1, 1))], "id int, organization_id string, sha256 string, deleted_at timestamp")
    assert {r.id: r.existing_id for r in index.duplicate_uploads(incoming, stored).collect()} == {10: 1, 11: None, 12: 11, 13: None}


def test_summary_counts_pages_without_chunks(spark):
    documents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    pages = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "source_id int, page int, ocr_used boolean")
    chunks = spark.createDataFrame([(1, 1)], "source_id int, page int")
    got = {r.id: tuple(r)[1:] for r in access.ingest_summary(documents, pages, chunks).collect()}
    assert got == {1: (2, 1, True, "completed"), 2: (1, 0, False, "failed"), 3: (0, 0, False, "failed")}


def test_embedding_texts(spark):
    row = {n: F.lit(v) for n, v in {"title": "t", "subject": "", "problem_description": "p", "actions_taken": "a", "lessons_learned": "l", "suggestion": "s"}.items()}
    got = spark.range(1).select(tx.experience_embedding_text(row, False).alias("a"), tx.experience_embedding_text(row, True).alias("b")).first()
    assert got.a == "t\np\nl\na" and got.b == "t\n\np\n\na\n\nl\n\ns"


def test_null_and_large_keys_have_their_own_limits(spark):
    rows = [(key, "x", t, 100 * n + i) for n, key in enumerate((None, 2**60, 2**60 + 1)) for i, t in enumerate(minutes(*range(4)))]
    df = spark.createDataFrame(rows, "key long, action string, ts timestamp, id long")
    got = {r.id: (r.key, r.allowed, r.remaining, r.reset_at) for r in replay.sliding_log_limit(df, {"default": (2, 30)}).collect()}
    assert len(got) == 12
    for key, _, ts, i in rows:
        assert got[i] == (key, i % 100 < 2, max(0, 1 - i % 100), ts + dt.timedelta(minutes=30))


def test_lockout_from_stored_state(spark):
    rows = [(u, t, 10 * n + i, True) for n, u in enumerate((None, 2**60, 2**60 + 1, 3)) for i, t in enumerate(minutes(0, 20))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, id long, success boolean")
    locked = dt.datetime(2024, 1, 1, 10, 10)
    users = spark.createDataFrame([(2**60, True, 4, locked, None), (2**60 + 1, True, None, None, locked), (3, False, 2, None, locked)], "id long, is_active boolean, failed_login_attempts int, locked_until timestamp, last_login timestamp")
    got = {r.id: (r.user_id, r.outcome, r.failures, r.locked_until, r.last_login) for r in replay.login_lockout(df, users).collect()}
    first, second = minutes(0, 20)
    assert got[0] == (None, "user_not_found", 0, None, None) and got[30] == (3, "account_inactive", 2, None, locked)
    assert got[10] == (2**60, "account_locked", 4, locked, None) and got[11] == (2**60, "success", 0, None, second)
    assert got[20] == (2**60 + 1, "success", 0, None, first)


def test_stamps_of_articles(spark):
    steps = [("UNDER_REVIEW", True), ("APPROVED", False), ("APPROVED", True), ("DRAFT", True), ("UNDER_REVIEW", True), ("APPROVED", True), ("PUBLISHED", True), ("ARCHIVED", True)]
    df = spark.createDataFrame([(1, i, t, 100 + i, 1000 + i, ok) for i, (t, ok) in enumerate(steps)], "item_id int, seq long, target string, user_id long, ts long, permitted boolean")
    got = {r.seq: r for r in workflow.knowledge_transitions(df).collect()}
    assert [got[i].accepted for i in range(8)] == [ok for _, ok in steps]
    assert (got[2].reviewed_by, got[2].approved_at, got[3].reviewed_by) == (102, 1002, 102)
    assert (got[4].reviewed_by, got[4].reviewed_at, got[4].approved_by) == (None, None, 102)
    assert (got[7].approved_by, got[7].published_by, got[7].archived_at) == (105, 106, 1007)


def test_stamps_of_lessons(spark):
    steps = [("submit", "n0", True), ("approve", "n1", True), ("reject", None, True), ("publish", "n3", True), ("archive", None, True), ("approve", "n5", False)]
    df = spark.createDataFrame([(1, i, a, 1000 + i, 100 + i, n, ok) for i, (a, n, ok) in enumerate(steps)], "item_id int, seq long, action string, ts long, user_id long, notes string, permitted boolean")
    r = workflow.experience_transitions(df).first()
    assert (r.status, r.submitted_by, r.approved_at, r.reviewed_by, r.review_notes, r.archived_at, r.embedding_cleared) == ("ARCHIVED", 100, 1001, 102, "n1", 1004, True)
    again = workflow.experience_transitions(df.unionByName(df.filter("action = 'publish'").withColumn("seq", F.lit(9).cast("long")))).first()
    assert (again.status, again.embedding_cleared) == ("PUBLISHED", False)


def test_runs_of_jobs(spark):
    jobs = spark.createDataFrame([(1, "PENDING", 0, 3), (2, "PENDING", 2, 3), (3, "PENDING", 0, 3), (4, "PROCESSING", 1, 3)], "id int, status string, retry_count int, max_retries int")
    t = minutes(*range(6))
    runs = spark.createDataFrame([(1, False, t[0], t[1]), (1, True, t[2], t[3]), (2, False, t[4], t[5]), (3, False, t[0], t[1])], "job_id int, ok boolean, started_at timestamp, ended_at timestamp")
    got = {r.id: tuple(r)[1:] for r in workflow.job_outcomes(jobs, runs).collect()}
    assert got == {1: (1, "COMPLETED", t[2], t[3]), 2: (3, "FAILED", t[4], t[5]), 3: (1, "PENDING", t[0], None), 4: (1, "PROCESSING", None, None)}


def test_tables_of_text_and_damaged_archives(spark, stored, tmp_path):
    raw = stored[1]["c.pptx"]
    at = raw.index(b"slide 2")
    made = {
        "a.csv": b"x;y;z\n1,5;2;3\n", "b.csv": b"x\ty\n1\t2\n", "c.csv": b"one cell, as prose\n\nwithout any order", "d.csv": b'big,"' + b"x" * 200_000 + b'"\n',
        "e.csv": b"", "f.pptx": raw[:at] + b"SLIDE 9" + raw[at + 7 :], "g.pptx": raw[: len(raw) // 2],
    }
    df = spark.createDataFrame([(n, n, bytearray(b)) for n, b in made.items()] + [("h.csv", "h.csv", None)], "source_id string, file_name string, content binary")
    text = {r.source_id: r.text for r in files.csv_pages(df.filter("file_name LIKE '%.csv'")).collect()}
    assert text["a.csv"] == "x | y | z\n1,5 | 2 | 3" and text["b.csv"] == "x | y\n1 | 2" and len(text["d.csv"]) == 200_006 and "h.csv" not in text
    assert text["c.csv"].startswith("one cell") and text["e.csv"] == ""
    assert files.office_pages(df.filter("file_name LIKE '%.pptx'")).count() == 0
    assert files.plain_text_pages(df.filter("file_name = 'h.csv'")).count() == 0


def test_large_files_are_named_not_dropped(spark, stored):
    found = files.read_files(spark, stored[0], most_bytes=10).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    rows = {r.file_name: r for r in found.select("file_name", "length", F.col("content").isNull().alias("none"), filters.upload_problem(F.col("file_name"), F.col("length"), 10).alias("problem")).collect()}
    assert set(rows) == set(stored[1]) and not rows["a.txt"].none and rows["a.txt"].problem is None
    assert rows["c.pptx"].none and rows["c.pptx"].problem == "too_big" and rows["c.pptx"].length == len(stored[1]["c.pptx"])


def test_declared_tables(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "org1", "more")], "id string, organization_id string, undeclared string")
    rows.write.parquet(str(tmp_path / "documents"))
    got = tables.read_declared(spark, str(tmp_path), "documents")
    assert "undeclared" not in got.columns and dict(got.dtypes)["deleted_at"] == "timestamp"
    assert [(r.id, r.organization_id, r.sha256) for r in got.collect()] == [("d1", "org1", None)]


def test_tables_of_a_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id", "concat('u', id) AS name").write.jdbc(url, "users", properties={"driver": driver})
    got = tables.read_jdbc(spark, url, "users", "id", (0, 100), 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100
    assert [tuple(r) for r in got.filter("id = 42").collect()] == [(42, "u42")]
