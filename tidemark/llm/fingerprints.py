"""Operator 1: canonical exact digests of documents, with built-in functions only.

Canonical form: Unicode NFKC, full case folding, NFKC again, runs of white space to
one space, ends trimmed. The Unicode steps call the ICU library that Spark ships, by
the SQL function java_method. The fingerprint is 128 bits wide: two xxhash64 values of
the canonical text under different seeds, as 32 hex digits. Documents are grouped by
fingerprint, and canonical texts are compared byte by byte inside equal buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_of, NULL_KEY, neighbours, save, small

_NOT_ASCII = r"[^\x00-\x7F]"
_WHITE = r"[\s\p{Z}\x{85}]+"


def _icu(owner: str, method: str, text: Column) -> Column:
    return F.call_function(
        "java_method", F.lit(f"com.ibm.icu.{owner}"), F.lit(method), text, F.lit(True)
    )


def canonical(text: Column) -> Column:
    """Canonical form of a text; a null counts as empty. ASCII texts skip ICU."""
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda c: _icu("text.Normalizer", "compose", c)
    folded = nfkc(_icu("lang.UCharacter", "foldCase", nfkc(text)))
    cased = F.when(text.rlike(_NOT_ASCII), folded).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(cased, _WHITE, " "))


def wide_hash(canon: Column) -> Column:
    """Two xxhash64 values under different seeds, as 32 lowercase hex digits."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("wide"), canon)))


def fingerprint(text: Column) -> Column:
    return wide_hash(canonical(text))


def with_fingerprints(rows: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """rows with the fingerprint of a text and check, the SHA-256 of its canonical form. This
    has a projection of its own, so that it is computed once for both."""
    shown = rows.withColumn("canon", canonical(F.col(text_col)))
    return shown.withColumns({name: wide_hash(F.col("canon")), "check": F.sha2("canon", 256)}).drop("canon")


def exact_classes(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of at least two rows with byte-equal canonical texts: fingerprint, check
    (SHA-256 of the canonical text), group_id (smallest id), group_size.

    Only texts whose fingerprint occurs twice or more are grouped by their bytes: they are
    found again by a hash of the text as it is, and only their canonical form is computed
    again. Copies collapse before the shuffle, so a class of any size costs a row a task.
    """
    plain = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    hashed = with_fingerprints(plain).groupBy("text_hash", "fingerprint").agg(F.count("*").alias("n"))
    hashed, _ = save(hashed, "hashed")
    repeated = hashed.groupBy("fingerprint").agg(F.sum("n").alias("n")).filter("n > 1").select("fingerprint")
    wanted, _ = save(hashed.join(repeated, "fingerprint", "left_semi").select("text_hash").distinct(), "repeated")
    wanted = small(wanted, wanted.count(), 16)
    return (
        plain.join(wanted, "text_hash", "left_semi")
        .select("id", canonical(F.col("text")).alias("canon"))
        .withColumn("fingerprint", wide_hash(F.col("canon")))
        .groupBy("fingerprint", "canon")
        .agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("fingerprint", F.sha2("canon", 256).alias("check"), "group_id", "group_size")
    )


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: id, fingerprint, group_id, group_size.

    Null texts count as empty; repeated rows each get a row; a class without any id has a
    null group_id; an empty table gives an empty result; other columns are not read.
    """
    rows = with_fingerprints(docs.select(F.col(id_col), F.col(text_col).alias("text"))).select(id_col, "fingerprint", "check")
    return _with_classes(rows, exact_classes(docs, id_col, text_col), id_col)


def _with_classes(rows: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    return (
        rows.join(classes, ["fingerprint", "check"], "left")
        .withColumn("group_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("group_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .drop("check", "canon")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edit replaces the last floor(n/4) code points of a text by the first as many of
    the next document's, in ascending doc_id; after the last comes the first. A null
    doc_id sorts before all others, a null text counts as empty, an empty table gives an
    empty result, other columns are not read. Rows that share a doc_id have the same next document;
    where the next doc_id has several rows, the one with the smallest fingerprint counts.
    The likeness of two exact digests is 1 if they are equal, else 0.
    """
    base = with_fingerprints(docs.select(key_of("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    keys = docs.select(
        key_of("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")
    ).groupBy("key").agg(F.max(quarter).alias("tail"))
    order, _ = save(neighbours(keys, "key", "tail").select("key", "prev_key", "prev_tail"), "prev")

    # both uses read the same columns, so the shuffle of base by key runs once
    heads = base.join(order, "key").groupBy("prev_key").agg(
        F.min(
            F.struct("fingerprint", "check", F.expr("substring(text, 1, prev_tail)").alias("head"))
        ).alias("next")
    )
    own = base.join(heads.withColumnRenamed("prev_key", "key"), "key")
    edited = F.concat(
        F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"),
        F.expr("substring(next.head, 1, cast(floor(char_length(text) / 4) as int))"),
    )
    rows = own.select(
        F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        "fingerprint",
        canonical(edited).alias("canon"),
        F.col("next.fingerprint").alias("next_fingerprint"),
        "check",
    ).withColumn("edited_fingerprint", wide_hash(F.col("canon")))
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return _with_classes(rows, exact_classes(docs), "doc_id").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        like("edited_fingerprint").alias("near_edited"),
        like("next_fingerprint").alias("near_next"),
        "group_id",
        "group_size",
    )
