"""Context, citations and extractive answers from ranked chunks.

ranked: (query_id, rank, chunk_id, source_type, source_id, source_title, page, section,
content, vector_score, fused_score), at most a few rows a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_CHARS, SOURCE_CHARS, ANSWER_CHARS, JOINER = 8000, 1200, 600, "\n\n---\n\n"
# ---- fixed values
LESSON_LABEL, SOURCE_LABEL = "تجربه ثبت‌شده", "منبع"
NO_ANSWER = "اطلاعات کافی در منابع مجاز سازمان برای پاسخ به این پرسش یافت نشد."
ANSWER_START = "بر اساس "
ANSWER_NOTICE = "(توجه: مدل هوش مصنوعی محلی در دسترس نیست. این پاسخ مستقیماً از متن منابع استخراج شده است.)"
CITED, CITED_PAGE, CITED_SECTION = "منابع:", "   صفحه ", "   بخش: "
# ---- end of fixed values


def context_budget(ranked: DataFrame, budget: int = CONTEXT_CHARS, per_source: int = SOURCE_CHARS) -> DataFrame:
    """The sources that fit: their parts in rank order up to the first that would pass the
    budget; the first source always. Adds part, part_chars and used_chars."""
    label = F.when(F.col("source_type") == "experience", LESSON_LABEL).otherwise(SOURCE_LABEL)
    part = F.concat(
        F.lit("["), label, F.lit(" "), F.col("rank").cast("string"), F.lit("] "), F.col("source_title"),
        F.lit("\n"), F.substring("content", 1, per_source),
    )
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    parts = ranked.withColumn("part", part).withColumn("part_chars", F.char_length("part"))
    return parts.withColumn("used_chars", F.sum("part_chars").over(so_far)).filter(
        (F.col("used_chars") <= budget) | (F.col("rank") == 1)
    )


def citation_index(used: DataFrame) -> DataFrame:
    """1-based place of each used source."""
    place = Window.partitionBy("query_id").orderBy("rank")
    return used.withColumn("citation_index", F.row_number().over(place))


def citation_score(vector_score: Column) -> Column:
    return F.round(F.greatest(vector_score, F.lit(0.0)), 3)


def confidence(top_score: Column, clamp: bool = True) -> Column:
    value = F.coalesce(top_score, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clamp else value


def _in_order(*columns: Column | str) -> Column:
    """Rows of one question in rank order; as many as the ranking kept."""
    return F.sort_array(F.collect_list(F.struct("rank", *columns)))


def citation_records(ranked: DataFrame) -> DataFrame:
    """(query_id, citations): a JSON array of the cited chunks."""
    record = F.struct(
        F.col("source_type").alias("sourceType"),
        F.col("source_id").alias("sourceId"),
        F.col("source_title").alias("sourceTitle"),
        "page",
        "section",
        F.col("chunk_id").alias("chunkId"),
        citation_score(F.col("vector_score")).alias("relevanceScore"),
    )
    rows = ranked.groupBy("query_id").agg(_in_order(record.alias("record")).alias("rows"))
    return rows.select("query_id", F.to_json(F.transform("rows", lambda r: r["record"])).alias("citations"))


def citation_text(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, citation_text): numbered lines with page and section where there are
    any; an empty text for a question without sources."""
    rows = ranked.groupBy("query_id").agg(_in_order("source_title", "page", "section").alias("rows"))
    line = lambda r, i: F.concat_ws(
        "\n",
        F.concat((i + 1).cast("string"), F.lit(". "), r["source_title"]),
        F.when(r["page"] != 0, F.concat(F.lit(CITED_PAGE), r["page"].cast("string"))),
        F.when(r["section"] != "", F.concat(F.lit(CITED_SECTION), r["section"])),
    )
    text = F.concat(F.lit(CITED + "\n"), F.array_join(F.transform("rows", line), "\n"))
    return queries.select("query_id").join(rows, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit("")).alias("citation_text")
    )


def extractive_answer(queries: DataFrame, used: DataFrame) -> DataFrame:
    """(query_id, answer, confidence) from the first used source of each question."""
    first = used.filter("rank = 1").select("query_id", "source_type", "source_title", "content", "fused_score")
    label = F.when(F.col("source_type") == "experience", LESSON_LABEL).otherwise(SOURCE_LABEL)
    said = F.concat(
        F.lit(ANSWER_START), label, F.lit(": «"), F.col("source_title"), F.lit("»:\n\n"),
        F.substring("content", 1, ANSWER_CHARS), F.lit("\n\n" + ANSWER_NOTICE),
    )
    return queries.select("query_id").join(first, "query_id", "left").select(
        "query_id", F.coalesce(said, F.lit(NO_ANSWER)).alias("answer"), confidence(F.col("fused_score"), False).alias("confidence")
    )


def retrieval_trace(queries: DataFrame, ranked: DataFrame, used: DataFrame) -> DataFrame:
    """(query_id, retrieved_count, used_count, top_scores, context_chars) of every question."""
    got = ranked.groupBy("query_id").agg(
        F.count("*").alias("retrieved_count"),
        F.transform(F.slice(_in_order("fused_score"), 1, 5), lambda r: r["fused_score"]).alias("top_scores"),
    )
    kept = used.groupBy("query_id").agg(
        F.count("*").alias("used_count"),
        (F.sum("part_chars") + len(JOINER) * (F.count("*") - 1)).alias("context_chars"),
    )
    rows = queries.select("query_id").join(got, "query_id", "left").join(kept, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = F.array().cast("array<double>")
    return rows.select(
        "query_id", zero("retrieved_count"), zero("used_count"), F.coalesce("top_scores", none).alias("top_scores"), zero("context_chars")
    )
