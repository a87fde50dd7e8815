"""Operator 12: a Merkle manifest of a dataset, its nodes labelled by nested intervals.

Leaves of a group are ranked in ascending order of their ids; a node is labelled by its level
and the interval [lo, hi) of the leaf ranks that it covers. A node of level m begins at a
multiple of WIDTH^m, so that a node's ancestor at that level is found by an equi-join on the
bucket lo div WIDTH^m and the containment of intervals, and its siblings are what the parent's
interval holds besides its own. Trees are built level by level, each an eighth of the one
before; paths to the root go down the same levels, so that each leaf is joined once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, save, small

WIDTH = 8
#: Every so many documents, by the checksum of the id, is changed in the proof of tampering.
TAMPERED = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*columns: Column) -> Column:
    """H of the values: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    said = (c.cast("string") for c in columns)
    return digest(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said))


def ranked(rows: DataFrame, group: str, *order: str | Column) -> DataFrame:
    """rows with rank (from 0) in each group and size, the number of its rows.

    Rows are range-partitioned by group and order, and numbered where they lie; only counts of
    (partition, group) meet. Rows that are alike in all of these are dealt by their place in
    the stored table, so a group or an order value of any size spreads over the tasks.
    """
    kept, _ = save(rows, "unranked")
    at = kept.withColumn("rank dealt", F.monotonically_increasing_id())
    by = [F.col(group).asc_nulls_first(), *order, F.col("rank dealt")]
    at = at.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    at, _ = save(at.withColumn("rank at", F.monotonically_increasing_id()), "ranked")
    shard = F.shiftrightunsigned("rank at", 33).alias("shard")
    edges = at.groupBy(shard, group).agg(F.min("rank at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        F.col("shard").alias("edge shard"),
        F.col(group).alias("edge group"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(group)).alias("size"),
    )
    edges, _ = save(edges, "edges")
    widest = edges.agg(F.coalesce(F.max(F.octet_length(F.col("`edge group`").cast("string"))), F.lit(0))).first()[0]
    on = F.col(group).eqNullSafe(F.col("`edge group`")) & (F.shiftrightunsigned("rank at", 33) == F.col("`edge shard`"))
    found = at.join(small(edges, edges.count(), widest + 40), on)
    return found.withColumn("rank", F.col("rank at") + F.col("shift")).drop("rank at", "rank dealt", "shift", "edge shard", "edge group")


def build(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The tops (grp, digest) of the trees over leaves (grp, rank, size, digest), and their
    levels above the leaves, lowest first: (grp, lo, hi, size, digest, children), where children
    are (lo, hi, digest) in order. A group is done once one node covers it; a lone leaf is its
    own top, so that it has no level above."""
    depth_of = leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    nodes = leaves.select("grp", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "size", "digest")
    levels, tops, span = [], [nodes.filter("size = 1").select("grp", "digest")], 1
    while span < depth_of:
        span *= WIDTH
        bucket = F.floor(F.col("lo") / span).cast("long").alias("bucket")
        child = F.struct("lo", "hi", "digest")
        # groups that one node covers already are left out; WIDTH rows at most meet in a bucket
        made = nodes.filter(F.col("size") > span // WIDTH).groupBy("grp", bucket).agg(F.array_sort(F.collect_list(child)).alias("children"), F.max("size").alias("size"))
        made = made.select(
            "grp",
            F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"),
            "size",
            F.sha2(F.array_join(F.col("children.digest"), ""), 256).alias("digest"),
            "children",
        )
        made, _ = save(made, "level")
        levels.append(made)
        nodes = made.drop("children")
        tops.append(nodes.filter(F.col("size") <= span).select("grp", "digest"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return top, levels


def paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """leaves with path, an array of (left, right): the digests of the siblings on both sides,
    level by level. above (grp, path) is what follows the top of each group's tree.

    A level's nodes take the path of their parent by a containment join on the bucket of the
    level above; a node that covers its group takes what is above.
    """
    start, known = None, above.withColumnRenamed("path", "above_path").withColumnRenamed("grp", "above_grp")
    for k in reversed(range(len(levels))):
        span = WIDTH ** (k + 1)
        nodes = levels[k]
        top = nodes.filter(F.col("size") <= span).join(known, F.col("grp").eqNullSafe(F.col("above_grp")))
        top = top.select("grp", "lo", "hi", "children", F.col("above_path").alias("path"))
        if start is not None:
            inner = _contained(nodes.filter(F.col("size") > span), start, span * WIDTH).select("grp", "lo", "hi", "children", "path")
            top = top.unionByName(inner)
        start, _ = save(top, "paths")
    lone = leaves.filter("size = 1").join(known, F.col("grp").eqNullSafe(F.col("above_grp")))
    lone = lone.drop("above_grp").withColumnRenamed("above_path", "path")
    if start is None:
        return lone
    ends = leaves.filter("size > 1").withColumns({"lo": F.col("rank"), "hi": F.col("rank") + 1})
    return lone.unionByName(_contained(ends, start, WIDTH).drop("lo", "hi"))


def _contained(nodes: DataFrame, parents: DataFrame, span: int) -> DataFrame:
    """nodes with their path: the siblings that their parent's interval (of span leaves) holds
    before and after their own, then the parent's path. A parent is found by its bucket."""
    up = parents.select(
        F.col("grp").alias("up_grp"),
        F.col("lo").alias("up_lo"),
        F.col("hi").alias("up_hi"),
        F.floor(F.col("lo") / span).cast("long").alias("up_bucket"),
        F.col("children").alias("up_children"),
        F.col("path").alias("up_path"),
    )
    inside = (
        F.col("grp").eqNullSafe(F.col("up_grp"))
        & (F.floor(F.col("lo") / span).cast("long") == F.col("up_bucket"))
        & (F.col("lo") >= F.col("up_lo"))
        & (F.col("hi") <= F.col("up_hi"))
    )
    apart = lambda keep: F.array_join(F.transform(F.filter("up_children", keep), lambda c: c["digest"]), "")
    step = F.struct(
        apart(lambda c: c["hi"] <= F.col("lo")).alias("left"),
        apart(lambda c: c["lo"] >= F.col("hi")).alias("right"),
    )
    found = nodes.join(up, inside).withColumn("path", F.concat(F.array(step), "up_path"))
    return found.drop("up_grp", "up_lo", "up_hi", "up_bucket", "up_children", "up_path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    leaf_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    text_col: str = "text",
    tampered: int = TAMPERED,
) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot (of its group), root, proof_sha256
    (of its siblings' digests up to the root), folded_root and verified.

    Where `tampered` divides the checksum of the id, folded_root is that of a leaf whose text
    has A-Z in lower case. Leaves ascend by id, null first, those of one id by their digest;
    rows alike in all columns are leaves of their own. A null group comes first and is a group
    of its own; a null text is tampered with in vain, a row without an id not at all; a lone row
    has no siblings; an empty table gives an empty result; further columns are not read.
    """
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    changed = leaf_digest(*(text if c == text_col else F.col(c) for c in leaf_cols))
    own = leaf_digest(*map(F.col, leaf_cols))
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % tampered == 0
    rows = docs.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(id_col).cast("long").alias("doc_id"),
        own.alias("digest"),
        F.when(chosen, changed).alias("tampered"),
    )
    leaves = ranked(rows, "grp", F.col("doc_id").asc_nulls_first(), "digest")
    leaves, _ = save(leaves, "leaves")
    subroots, levels = build(leaves)
    subroots, _ = save(subroots.withColumnRenamed("digest", "subroot"), "subroots")

    # the subroots are the leaves of one more tree, whose group is the whole dataset
    langs = subroots.select(F.lit("all").alias("whole"), F.col("grp").alias("lang"), F.col("subroot").alias("digest"))
    ends = ranked(langs, "whole", F.col("lang").asc_nulls_first()).withColumnRenamed("whole", "grp")
    ends, _ = save(ends, "subroot-leaves")
    top, upper = build(ends)
    top = top.select(F.col("grp").alias("top_grp"), F.col("digest").alias("root"))  # one row
    nothing = top.select(F.col("top_grp").alias("grp"), F.array().cast(_STEP).alias("path"))
    above = paths(ends, upper, nothing).select(F.col("lang").alias("grp"), "path")
    above, _ = save(above, "subroot-paths")

    found = paths(leaves, levels, above)
    names = subroots.withColumnRenamed("grp", "sub_grp").join(F.broadcast(top))  # one row
    names, _ = save(names.select("sub_grp", "subroot", "root"), "roots")
    widest = names.agg(F.coalesce(F.max(F.octet_length("sub_grp")), F.lit(0))).first()[0]
    found = found.join(small(names, names.count(), widest + 160), F.col("grp").eqNullSafe(F.col("sub_grp")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS entries
  FROM (SELECT unnest(range(256)) AS b)),
"""

MANIFEST_SQL = (
    "WITH RECURSIVE"
    + _CRC_SQL
    + """
rows_ AS (
  SELECT lang, doc_id,
         sha256(own_head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(own_head || coalesce(strlen(low) || ':' || low, '-')) AS changed,
         coalesce(xor(4294967295, list_reduce([4294967295] || bytes,
           lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1]))) % 3 = 0, false) AS chosen
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own_head,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS bytes
        FROM documents) CROSS JOIN crc_table),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM rows_),
nodes AS (
  SELECT lang, 0 AS level, rank, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, rank // 8),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang COLLATE "binary" NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, rank, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(n) + 7) // 8
  FROM upper_nodes WHERE n > 1 GROUP BY level, rank // 8),
runs AS (
  SELECT lang, level, rank // 8 AS run, list(digest ORDER BY rank) AS digests FROM nodes WHERE n > 1 GROUP BY lang, level, rank // 8),
upper_runs AS (
  SELECT level, rank // 8 AS run, list(digest ORDER BY rank) AS digests FROM upper_nodes WHERE n > 1 GROUP BY level, rank // 8),
folds AS (
  SELECT lang, rank AS leaf_rank, 0 AS level, rank AS place, CASE WHEN chosen THEN changed ELSE leaf END AS own, '' AS proof FROM leaves
  UNION ALL
  SELECT f.lang, leaf_rank, f.level + 1, place // 8,
         sha256(array_to_string(digests[:place % 8], '') || own || array_to_string(digests[place % 8 + 2:], '')),
         proof || array_to_string(digests[:place % 8], '') || array_to_string(digests[place % 8 + 2:], '')
  FROM folds f JOIN runs r ON f.lang IS NOT DISTINCT FROM r.lang AND f.level = r.level AND f.place // 8 = r.run),
lower_ends AS (
  SELECT lang, leaf_rank, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM folds GROUP BY lang, leaf_rank),
upper_folds AS (
  SELECT e.lang, leaf_rank, 0 AS level, s.rank AS place, own, proof FROM lower_ends e JOIN subroots s ON e.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT f.lang, leaf_rank, f.level + 1, place // 8,
         sha256(array_to_string(digests[:place % 8], '') || own || array_to_string(digests[place % 8 + 2:], '')),
         proof || array_to_string(digests[:place % 8], '') || array_to_string(digests[place % 8 + 2:], '')
  FROM upper_folds f JOIN upper_runs r ON f.level = r.level AND f.place // 8 = r.run),
ends AS (
  SELECT lang, leaf_rank, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM upper_folds GROUP BY lang, leaf_rank)
SELECT l.doc_id, l.leaf, s.subroot, u.digest AS root, sha256(e.proof) AS proof_sha256, e.own AS folded_root, e.own = u.digest AS verified
FROM leaves l
JOIN ends e ON l.lang IS NOT DISTINCT FROM e.lang AND l.rank = e.leaf_rank
JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
CROSS JOIN (SELECT digest FROM upper_nodes WHERE n = 1) u
"""
)
