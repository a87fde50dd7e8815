"""Operator 7: mix sources to target weights, with built-in functions only.

Tokens are aggregated per source, a repetition rate follows from each source's target,
and a document is emitted floor(rate) times plus one copy drawn with probability equal
to the fraction, by a hash of its id, its text and its place among rows that repeat both:
each row has a draw of its own, and reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, quoted, save, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of the mix, as percent of all words, and the most repeats of a source.
SHARE_PERCENT, MOST_REPEATS = 150, 2


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_repeats: int = MOST_REPEATS,
) -> tuple[DataFrame, int]:
    """(source, source_size, target) of sized (source, size), and the number of sources.

    Sources take the weights in turn, by code point, null last. A source's target is its
    weight's share of share_percent of all words; one that would pass most_repeats times
    its size stops there, and the rest is dealt again by weight until none is above.
    Each round is one aggregation over the sources; only two sums come to the driver.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # place in the order of all sources: range partitions, and the sizes of those before
    parts = (
        sums.withColumn("no_source", F.col("source").isNull().cast("int"))
        .repartitionByRange(partitions(spark), "no_source", "source")
        .withColumn("shard", F.spark_partition_id())
    )
    parts, _ = save(parts, "sources")
    before = parts.groupBy("shard").count().select(
        "shard",
        (F.sum("count").over(Window.orderBy("shard")) - F.col("count")).alias("before"),
    )
    place = (
        F.row_number().over(Window.partitionBy("shard").orderBy("no_source", "source"))
        + F.col("before")
        - 1
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    table, _ = save(
        parts.join(F.broadcast(before), "shard").select(  # one row a partition
            "source", "source_size", weight.cast("long").alias("weight")
        ),
        "weights",
    )
    cap = F.col("source_size") * most_repeats
    total, n_sources = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    budget = share_percent * total  # in hundredths of a word, so that all is whole numbers
    level = (budget, 0)  # target of an uncapped source: weight * level[0] / (100 * level[1])
    capped = F.lit(False)
    while True:
        rest, shares = table.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        now = (budget - 100 * rest, shares)
        if now == level or not shares:
            break
        level = now
        capped = F.col("weight") * level[0] > cap * (100 * level[1])
    # the last level is the one that sets no further source aside
    uncapped = F.col("weight").cast("double") * float(level[0]) / float(100 * max(level[1], 1))
    target = F.when(capped, cap.cast("double")).otherwise(uncapped)
    return table.select("source", "source_size", target.alias("target")), n_sources


#: Columns that plan_mix uses or adds.
ADDED = ("mix_source", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_seed", "mix_nth", "mix_copy")


def draw(seed: Column) -> Column:
    """Uniform number in [0, 1) from a seed."""
    return F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def _numbered(docs: DataFrame, source_col: str) -> DataFrame:
    """docs (with mix_seed) with mix_nth: 0, 1, ... among the rows of one source and seed.

    Only rows that repeat are numbered. They are stored with a number each; ranks inside a
    partition of the table that is stored and counts of the partitions before give the place,
    so rows that are all alike spread over as many tasks as wrote them.
    """
    key = [F.col(source_col).cast("string").alias("again_source"), F.col("mix_seed").alias("again_seed")]
    repeated = docs.select(*key).groupBy("again_source", "again_seed").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated, _ = save(repeated, "repeated-rows")
    n_repeated = repeated.count()
    if not n_repeated:
        return docs.withColumn("mix_nth", F.lit(0).cast("long"))
    widest = repeated.agg(F.coalesce(F.max(F.octet_length("again_source")), F.lit(0)) + F.max(F.octet_length("again_seed"))).first()[0]
    few = small(repeated, n_repeated, widest + 32)
    same = F.col(source_col).cast("string").eqNullSafe(F.col("again_source")) & (F.col("mix_seed") == F.col("again_seed"))
    once = docs.join(few, same, "left_anti").withColumn("mix_nth", F.lit(0).cast("long"))
    stored = docs.join(few, same).withColumn("mix_nth", F.monotonically_increasing_id())
    stored, _ = save(stored.withColumn("mix_copy", F.shiftrightunsigned("mix_nth", 33)), "alike")
    counts = stored.groupBy("again_source", "again_seed", "mix_copy").agg(F.count("*").alias("n"))
    before = Window.partitionBy("again_source", "again_seed").orderBy("mix_copy").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("again_source").alias("start_source"), F.col("again_seed").alias("start_seed"), F.col("mix_copy").alias("start_copy"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    inside = Window.partitionBy("again_source", "again_seed", "mix_copy").orderBy("mix_nth")
    at = F.col("again_source").eqNullSafe(F.col("start_source")) & (F.col("again_seed") == F.col("start_seed")) & (F.col("mix_copy") == F.col("start_copy"))
    placed = stored.withColumn("mix_nth", F.row_number().over(inside).cast("long")).join(starts, at)
    placed = placed.withColumn("mix_nth", F.col("mix_nth") - 1 + F.col("start"))
    return once.unionByName(placed.select(*map(quoted, once.columns)))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **targets,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (see source_targets).

    A null text has size 0, a null source is a source of its own, and a source without
    words has target 0 and keeps no copy. Each row has its own draw, also where rows share an
    id or have none, or repeat id and text. An empty table gives an empty plan. Columns of
    docs with the names in ADDED are replaced.
    """
    docs = docs.drop(*ADDED)
    text = F.col(text_col)
    docs = docs.withColumn("mix_seed", F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    sized = docs.select(F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"))
    table, n_sources = source_targets(sized, **targets)
    widest = table.agg(F.coalesce(F.max(F.octet_length("source")), F.lit(0))).first()[0]
    table = small(table, n_sources, widest + 64).select(
        F.col("source").alias("mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    seed = F.concat_ws(":", F.lit("mix"), "mix_seed", F.col("mix_nth").cast("string"))
    extra = (draw(seed) < rate - F.floor(rate)).cast("int")
    return (
        _numbered(docs, source_col)
        .join(table, F.col(source_col).cast("string").eqNullSafe(F.col("mix_source")))
        .withColumn("mix_size", word_count(text))
        .withColumn("mix_copies", F.floor(rate).cast("int") + extra)
        .drop("mix_source", "mix_seed", "mix_nth")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """The mixed rows themselves: each document as often as plan_mix says, with its columns
    but those that plan_mix adds; nulls, repeated rows and empty tables are as it says."""
    columns = [quoted(c) for c in docs.columns if c not in ADDED]
    planned = plan_mix(docs, id_col, text_col, source_col, **targets).filter("mix_copies > 0")
    return planned.select(*columns, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")).drop("mix_copy")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes of each document, a row
    for each row of docs; nulls, repeated rows and empty tables are as plan_mix says."""
    return plan_mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, seed, row_number() OVER (PARTITION BY source, seed) - 1 AS nth,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, '')) AS seed FROM documents)),
sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1]::BIGINT AS weight
  FROM sized GROUP BY source),
-- sources reach their cap in the order of source_size / weight; the level of the rest
-- after each of them tells how many are capped
ranked AS (
  SELECT *, row_number() OVER w AS place,
         150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER before, 0) AS budget,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS shares
  FROM sums
  WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source COLLATE "binary"),
         before AS (ORDER BY source_size / weight, source IS NULL, source COLLATE "binary"
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (
  SELECT min(place) AS place FROM ranked
  WHERE weight::HUGEINT * budget <= 2 * source_size::HUGEINT * 100 * shares),
targets AS (
  SELECT r.source, r.source_size,
         CASE WHEN f.place IS NULL OR r.place < f.place THEN (2 * r.source_size)::DOUBLE
              ELSE r.weight::DOUBLE * l.budget::DOUBLE / (100 * l.shares)::DOUBLE END AS target
  FROM ranked r CROSS JOIN first_free f LEFT JOIN ranked l ON l.place = f.place)
SELECT s.doc_id, s.size, t.source_size, t.target,
       (s.size * (floor(rate) +
        CASE WHEN ('0x' || substr(md5('mix:' || s.seed || ':' || s.nth), 1, 13))::BIGINT
                  / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets) t
  ON s.source IS NOT DISTINCT FROM t.source
"""
