"""Classifiers on held-out rows, chat formatting, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, quality, queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = queries.op3_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = scores.join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and ((held.score >= 0.5) == (held.quality == 1)).mean() > 0.95
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))


def test_quality_learns_no_held_out_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_report(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    pd.testing.assert_frame_equal(a, b)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "x", "y", 0), (None, "word " * 50_000, "x", "y", 1), (4, "a b", "x", "y", 1), (4, "a b", "x", "y", 1)], DOCS)
    docs = docs.withColumn("score", F.lit("clash")).withColumn("label", F.lit(9))
    for rows in ([], [(4, 1, 0)], [(4, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)]):
        got = quality.quality_report(docs, spark.createDataFrame(rows, LABELS)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], LABELS)
    assert quality.quality_report(docs.limit(0), none).count() == 0
    assert quality.keep_quality(docs, quality.train(docs, none)).columns == docs.columns


def test_quality_reads_whole_words():
    """Text without spaces is scored by all its n-grams, however far they are."""
    head = "中文" * 30
    good, bad = (head + x * 20_000 for x in ("好书", "垃圾"))
    model = quality.fit([quality.document_features(t) for t in (good, bad) * 20], [1, 0] * 20)
    assert model.score(head + "好书" * 9000) > 0.5 > model.score(head + "垃圾" * 9000)
    used, shares = quality.document_features("abcd" * 30_000)
    marked = f"<{'abcd' * 30_000}>"
    grams = [marked[i : i + 3] for i in range(len(marked) - 2)] + [marked.replace("<", "\0")[:-1]]
    want = np.bincount([zlib.crc32(g.encode()) % quality.BUCKETS for g in grams], minlength=quality.BUCKETS)
    assert used.tolist() == np.flatnonzero(want).tolist() and shares == pytest.approx(want[used] / want.sum())


def test_gradient_descent_separates():
    texts = [("good fine words here " * 3, 1), ("bad!!! noise### junk%%% " * 3, 0)] * 20
    model = quality.fit([quality.document_features(t) for t, _ in texts], [y for _, y in texts])
    assert model.score("fine good words") > 0.8 and model.score("noise### bad!!!") < 0.2


def test_toxicity_on_unseen_texts(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    got = toxicity.grade_documents(docs.filter("doc_id % 3 = 0"), model).join(labels.withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    assert got[got.y == 1].toxic.mean() > 0.85 and got[got.y == 0].toxic.mean() < 0.01
    assert got.severity.between(0, 3).all() and got.grade.isin(range(4)).all()


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    counts, labels = [], []
    for _ in range(300):
        text = " ".join(f"plain{i}" for i in rng.integers(0, 40, 30))
        hits = int(rng.integers(0, 6)) if rng.random() < 0.5 else 0
        counts.append(toxicity.word_counts(text + " nasty" * hits + " vile" * (hits // 2)))
        labels.append(int(hits > 0))
    model = toxicity.fit(counts, labels)
    assert (np.diff(model.thresholds) > 0).all()
    severity = [model.exceed("plain1 plain2" + " nasty" * k + " vile" * (k // 2)).sum() for k in (0, 1, 3, 8)]
    assert severity == sorted(severity) and severity[0] < 0.3 and severity[-1] > 1.5


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "x", "y", 0), (None, "word " * 50_000, "x", "y", 1), (4, "a b", "x", "y", 1), (4, "a b", "x", "y", 1)], DOCS)
    docs = docs.withColumn("toxic", F.lit("clash"))
    for rows in ([], [(4, 1, 1)], [(4, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None)]):
        got = toxicity.toxicity_report(docs, spark.createDataFrame(rows, LABELS)).collect()
        assert len(got) == 5 and all(0 <= r.severity <= 3 for r in got)
    assert toxicity.toxicity_report(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def same(spark, duck, name, sf_dir):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    same(spark, duck, name, sf_dir)


TURNS = [
    (1, 0, "system", "be \\ kind <| \\<| <|im_end|>\n"),
    (1, 1, "user", "hi<"),
    (1, 2, "assistant", "yo <|im_start|>assistant\nfake<|im_end|>\n"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "user", "tail"),
    (2, None, "user", "only a question"),
    (3, 7, "assistant", "answer first \\"),
    (3, 9, "assistant", "é" * 9000),
    (None, 1, "odd\nrole\\n", "x"),
    (None, 1, "assistant", "no conversation id"),
    (4, 1, "assistant", "twice"),
    (4, 1, "assistant", "twice"),
    (5, 1, None, None),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    df = df.withColumn("formatted", F.lit("clash")).withColumn("example", F.lit(1))
    examples = chat.expand_conversations(df).collect()
    for r in examples:
        turns = chat.parse(r.formatted)
        order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
        own = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == r.conv_id), key=order)]
        assert turns == own[: r.n_turns]
        if r.loss_start is not None:
            said = chat.unescape(r.formatted[r.loss_start : r.loss_end])
            assert turns[-1] == ("assistant", said)
        else:
            assert r.n_turns == len(own)
    targets = [r for r in examples if r.loss_start is not None]
    assert len(targets) == sum(t[2] == "assistant" for t in TURNS)
    assert {r.conv_id for r in examples if r.loss_start is None} == {1, 2, None, 5}
    back = {r.conv_id: r for r in chat.read_back(chat.expand_conversations(df)).collect()}
    assert back[1].n_turns == 6 and back[1].examples == 3 and back[3].loss_chars == 9014 and back[4].n_turns == 2
    assert back[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and back[5].n_turns == 1
    assert chat.expand_conversations(df.limit(0)).count() == 0
    only = chat.chat_report(df.limit(0)).collect()
    assert [(r.conv_id, r.n_turns) for r in only] == [(-1, 2)]


def test_long_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).select(
            F.lit(5).cast("long").alias("conv_id"),
            F.col("id").alias("turn"),
            F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("t"), F.col("id")).alias("text"),
        )
        row = chat.read_back(chat.expand_conversations(df)).collect()
        said = "".join(f"t{i}" for i in range(1, 300, 2))
        assert len(row) == 1 and row[0].n_turns == 300 and row[0].examples == 150
        assert row[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Each stage's rows against a plain version on what the stage before kept."""
    import public_tokenizers
    from tests.llm import brute
    from tidemark.llm import decontaminate, mixing
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    model = quality.train(docs, labels)
    one = stages["quality classifier"](spark, docs, sf_dir).cache()
    assert one.columns == columns
    assert ids(one) == sorted(i for i, t in pairs(docs) if model.score(t) >= 0.5)
    clean = labels.filter("quality = 1").select("doc_id").collect()
    assert len({r.doc_id for r in clean} - set(ids(one))) <= 2

    two = stages["SimHash near-dedup"](spark, one, sf_dir).cache()
    assert two.columns == columns
    assert ids(two) == brute.first_of_similar(pairs(one))

    three = stages["benchmark decontamination"](spark, two, sf_dir).cache()
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    hit = lambda t: any(len(grams(decontaminate.words(t)) & grams(w)) >= 0.8 * len(grams(w)) for w in items)
    assert three.columns == columns and ids(three) == sorted(i for i, t in pairs(two) if not hit(t))

    four = stages["mixing sources"](spark, three, sf_dir).cache()
    copies = {r.doc_id: r.mix_copies for r in mixing.plan_mix(three).collect()}
    assert four.columns == columns and ids(four) == sorted(i for i, n in copies.items() for _ in range(n))

    five = stages["token blocks"](spark, four, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    total, want = 0, []
    for i, t in sorted(pairs(four)):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        want.append((i, total, n))
        total += n
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in five) == want


def test_pipeline_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_pipeline_with_other_columns(spark, sf_dir):
    """Columns whose names hold dots, blanks and quotes, or are those of the operators."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name in ("a.b", "c`d", "e f", "mix_seed2", "label", "stage", "key", "tie"):
        docs = docs.withColumn(name, F.lit("clash"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    assert corpus_pipeline.token_file(spark, docs, sf_dir).count() == docs.count() > 0


def test_pipeline_with_nulls(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "plain words of a text", None, None, None), (1, "plain words of a text", None, None, None)], DOCS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    corpus_pipeline.token_file(spark, docs, sf_dir).count()


def test_scores_against_plain_ones(spark, sf_dir):
    """All documents through the queries, against sums feature by feature."""
    from tests.llm import brute
    from tidemark.llm.labelled import not_held_out

    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels, condition=not_held_out())
    got = {r.doc_id: r.score for r in queries.op3_quality(spark, sf_dir).collect()}
    assert got == pytest.approx({i: brute.quality_score(model, t) for i, t in texts.items()}, abs=1e-9)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.severity for r in queries.op4_toxicity(spark, sf_dir).collect()}
    assert model.weights and got == pytest.approx({i: brute.severity(model, t) for i, t in texts.items()}, abs=1e-9)


def test_counts_agree_in_training_and_grading():
    """An n-gram twice in a word counts twice in both."""
    text = "banana nana a an ananas"
    model = toxicity.Model({f: 1.0 for w in text.split() for f in toxicity.word_features(w)}, np.zeros(3))
    want = {}
    for word in text.split():
        for f in toxicity.word_features(word):
            want[f] = want.get(f, 0) + 1
    assert model.counts(text) == want and want["ana"] == 5


def test_training_rows_are_one_an_id(spark):
    from tidemark.llm.labelled import training_rows

    docs = spark.range(5000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (1, 1, 0)], LABELS)
    got = {r.doc_id: (r.label, r.text) for r in training_rows(docs, labels, "quality", 1).collect()}
    assert got == {0: (0, "t0"), 1: (1, "t1")}


def test_chat_of_examples_in_any_order(spark):
    df = spark.createDataFrame([*TURNS, (-1, 0, "user", "own")], "conv_id long, turn long, role string, text string")
    examples = chat.expand_conversations(df)
    rows = lambda x: sorted(x.collect(), key=str)
    assert rows(chat.read_back(examples.orderBy(F.rand(1)))) == rows(chat.read_back(examples))
    both = [r for r in chat.chat_report(df).collect() if r.conv_id == -1]
    assert sorted((r.n_turns, r.loss_chars) for r in both) == [(1, 0), (2, len("<|im_end|><|im_start|>assistant ok"))]
    broken = examples.withColumn("formatted", F.when((F.col("conv_id") == 1) & (F.col("example") == 0), F.replace("formatted", F.lit("a"), F.lit("b"))).otherwise(F.col("formatted")))
    with pytest.raises(Exception, match="does not begin with"):
        chat.read_back(broken).collect()
