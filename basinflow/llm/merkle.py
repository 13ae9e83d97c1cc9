"""A Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof for every document.

Leaves are numbered per source in two steps (range-sorted partitions, counts per
partition added up), so a source that holds most documents lies in many tasks. Levels are
DataFrames: the index of a node, divided by ``fanout`` and floored, is its run; the sorted
digests of a run hash into its parent, until each tree has one node. The trees' roots,
numbered by source, are the leaves of one more tree in the same way. The driver counts
levels, of which there are log(rows) to the base of ``fanout``, and sees one root.

Proofs go up a run at a time, not a leaf at a time: a row holds the leaves of a run, and
one join a level appends its siblings above, to the subroot and on to the root. A join is keyed by
(source, index), so no key has more rows than the node has runs below it. What a
source has above its subroot reaches the runs keyed by (source, partition of the sort), as the one source
with most runs lies in most partitions. Texts are read once and never shuffled: a leaf and, for the
check, the leaf of the tampered row are all that leaves the scan.

Defined results: columns are cast to long (doc_id, n_chars) and string; nulls hash as ``-``.
A null doc_id comes first in its source; rows that tie on doc_id are ordered by their leaf, so
rows that are repeated whole are leaves of their own with equal digests. A null source is a tree of its own, the
first. A source of one document is its leaf; a dataset of one source has its subroot as root. A null doc_id is
never tampered with. An empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm.common import ascii_lower, materialize, read_table
from basinflow.operators.ranks import deal_in_order, group_starts, number_in_groups

FANOUT, DIGEST = 16, 32
PATH = "array<struct<pos:int,kids:binary>>"


def leaf_digest(text: Column) -> Column:
    """The digest of a document, as bytes."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text]
    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256))


def digest(children: Column) -> Column:
    """The digest of a node from the digests of its children, joined as bytes; they are hashed as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(children)).cast("binary"), 256))


def _others(kids: Column, pos: Column) -> tuple[Column, Column]:
    return F.substring(kids, F.lit(1), pos * DIGEST), F.substring(kids, (pos + 1) * DIGEST + 1, F.octet_length(kids))


def siblings(kids: Column, pos: Column) -> Column:
    return F.concat(*_others(kids, pos))


def replaced(kids: Column, pos: Column, node: Column) -> Column:
    before, after = _others(kids, pos)
    return F.concat(before, node, after)


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def build_levels(nodes: DataFrame, tree: str, fanout: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level as (tree, at, kids), and (tree, subroot) of every tree.

    ``nodes`` is (tree, n, idx, digest), ``n`` being the nodes of the tree and ``most`` the greatest ``n``.
    """
    levels, done = [], nodes.where("n = 1").select(tree, F.col("digest").alias("subroot"))
    while most > 1:
        runs = nodes.where("n > 1").groupBy(tree, "n", F.floor(F.col("idx") / fanout).cast("long").alias("at"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        runs = materialize(runs.select(tree, "n", "at", _joined(F.col("kids.digest")).alias("kids")), "runs")
        levels.append(runs.select(tree, "at", "kids"))
        nodes = runs.select(tree, F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("at").alias("idx"), digest(F.col("kids")).alias("digest"))
        done = done.unionByName(nodes.where("n = 1").select(tree, F.col("digest").alias("subroot")))
        most = -(-most // fanout)
    return levels, done


def append_paths(rows: DataFrame, tree: str, at: str, levels: list[DataFrame], fanout: int) -> DataFrame:
    """``rows`` with the runs above node ``at`` appended to ``path``, one join a level; trees that end below a level have none there."""
    for runs in levels:
        up = runs.select(F.col(tree).alias("_tree"), F.col("at").alias("_at"), F.col("kids").alias("_kids"))
        rows = rows.withColumn("_pos", F.pmod(F.col(at), F.lit(fanout)).cast("int")).withColumn(at, F.floor(F.col(at) / fanout).cast("long"))
        rows = rows.join(up, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col(at) == F.col("_at")), "left")
        step = F.array(F.struct(F.col("_pos").alias("pos"), F.col("_kids").alias("kids"))).cast(PATH)
        rows = rows.withColumn("path", F.when(F.col("_kids").isNotNull(), F.concat("path", step)).otherwise(F.col("path")))
        rows = rows.drop("_pos", "_tree", "_at", "_kids")
    return rows


def build_manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, tampered_leaf, subroot, root, path, shown) for every document; digests are bytes.

    ``path`` lists, from the leaf to the root, the digests of the run at each level and the place of the own
    node in it. ``shown`` is the digest of a text that ``tampered`` gives for some rows, else null.
    """
    spark = docs.sparkSession
    fields = [F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), *fields)
    shown = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(tampered))
    leaves = materialize(texts.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), shown.alias("shown")), "digests")
    dealt = deal_in_order(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], "part", "at")
    starts = materialize(group_starts(dealt, ["source"], "part", "at"), "starts")
    most = starts.agg(F.max("size")).first()[0]
    if most is None:
        return _empty(spark)
    begins = starts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "shift", F.col("size").alias("n"))
    numbered = dealt.join(begins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    numbered = numbered.withColumn("idx", F.col("at") + F.col("shift"))
    doc = F.struct("idx", "doc_id", "leaf", "shown")
    runs = numbered.groupBy("source", "n", F.floor(F.col("idx") / fanout).cast("long").alias("at")).agg(
        F.array_sort(F.collect_list(doc)).alias("docs"), F.min("part").alias("part")
    )
    runs = materialize(runs.withColumn("kids", _joined(F.col("docs.leaf"))), "leaves")
    above = runs.select("source", F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("at").alias("idx"), F.when(F.col("n") > 1, digest(F.col("kids"))).otherwise(F.col("kids")).alias("digest"))
    levels, subroots = build_levels(above, "source", fanout, -(-most // fanout))
    # The tree over sources.
    top = number_in_groups(materialize(subroots, "subroots"), [], [F.col("source").asc_nulls_first()], "idx")
    top = materialize(top.select("source", "subroot", "idx"), "top")
    trees = top.count()
    nodes = top.select(F.lit(0).alias("tree"), F.lit(trees).cast("long").alias("n"), "idx", F.col("subroot").alias("digest"))
    higher, roots = build_levels(nodes, "tree", fanout, trees)
    root = F.lit(bytes(roots.first()["subroot"]))
    by_source = append_paths(top.withColumn("tree", F.lit(0)).withColumn("path", F.array().cast(PATH)), "tree", "idx", higher, fanout)
    by_source = by_source.select(F.col("source").alias("_source"), "subroot", F.col("path").alias("upper"))
    # A row for each source and partition that has leaves of it: no source is a hot key of the next join.
    spread = starts.select("source", "part").join(by_source, F.col("source").eqNullSafe(F.col("_source")))
    spread = spread.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "subroot", "upper")
    up = append_paths(runs.withColumn("path", F.array().cast(PATH)), "source", "at", levels, fanout)
    up = up.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    up = up.select("n", "kids", "subroot", F.concat("path", "upper").alias("above"), F.explode("docs").alias("d"))
    own = F.array(F.struct(F.pmod(F.col("d.idx"), F.lit(fanout)).cast("int").alias("pos"), "kids")).cast(PATH)
    path = F.when(F.col("n") > 1, F.concat(own, F.col("above"))).otherwise(F.col("above"))
    return up.select("d.doc_id", "d.leaf", "d.shown", "subroot", root.alias("root"), path.alias("path"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"doc_id long, leaf binary, shown binary, subroot binary, root binary, path {PATH}")


def proof_digests(path: Column) -> Column:
    """The siblings on the way to the root, level by level, joined as bytes."""
    return F.aggregate(path, F.lit(b""), lambda a, x: F.concat(a, siblings(x["kids"], x["pos"])))


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda node, x: digest(replaced(x["kids"], x["pos"], node)))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = build_manifest(read_table(spark, sf_dir, "documents"), FANOUT, F.when(bad, ascii_lower(F.col("text"))))
    text = lambda c: F.lower(F.hex(c))
    # An unchanged leaf, or a tampered null, folds as it is.
    folded = made.withColumn("folded", fold(F.col("path"), F.coalesce("shown", "leaf")))
    return folded.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        text(digest(proof_digests(F.col("path")))).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: crc32 by bits: its generator is a fixed value.
OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                               lambda a, c: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(a, c)),
                               4294967295) IS NULL THEN FALSE
              ELSE xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                               lambda a, c: list_reduce(range(8), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(a, c)),
                               4294967295), 4294967295) % 5 = 0 END AS bad
  FROM documents
), s AS (
  SELECT doc_id, source, bad,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS changed
  FROM d
), leaf AS (
  SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || CASE WHEN bad THEN changed ELSE tail END) AS shown FROM s
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (ORDER BY source, doc_id, leaf) AS doc FROM leaf
), nodes(level, source, n, idx, digest) AS (
  SELECT 0, source, n, idx, leaf FROM numbered
  UNION ALL
  SELECT level + 1, source, (n + 15) // 16, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, source, n, idx // 16
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), top(level, n, idx, digest) AS (
  SELECT 0, n, idx, subroot FROM subroots
  UNION ALL
  SELECT level + 1, (n + 15) // 16, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 16
), runs AS (
  SELECT level, source, idx // 16 AS at, list(digest ORDER BY idx) AS kids FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, idx // 16 AS at, list(digest ORDER BY idx) AS kids FROM top WHERE n > 1 GROUP BY ALL
), up(doc, source, level, idx, node, proof) AS (
  SELECT doc, source, 0, idx, shown, '' FROM numbered
  UNION ALL
  SELECT doc, u.source, u.level + 1, u.idx // 16, sha256(array_to_string(kids[:u.idx % 16] || [node] || kids[u.idx % 16 + 2:], '')),
         proof || array_to_string(kids[:u.idx % 16] || kids[u.idx % 16 + 2:], '')
  FROM up u JOIN runs r ON r.level = u.level AND r.source IS NOT DISTINCT FROM u.source AND r.at = u.idx // 16
), over_sources(doc, level, idx, node, proof) AS (
  SELECT doc, 0, s.idx, node, proof FROM (SELECT * FROM up QUALIFY level = max(level) OVER (PARTITION BY doc)) u JOIN subroots s ON s.source IS NOT DISTINCT FROM u.source
  UNION ALL
  SELECT doc, u.level + 1, u.idx // 16, sha256(array_to_string(kids[:u.idx % 16] || [node] || kids[u.idx % 16 + 2:], '')),
         proof || array_to_string(kids[:u.idx % 16] || kids[u.idx % 16 + 2:], '')
  FROM over_sources u JOIN top_runs r ON r.level = u.level AND r.at = u.idx // 16
), ends AS (SELECT * FROM over_sources QUALIFY level = max(level) OVER (PARTITION BY doc))
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, node AS folded_root,
       node = (SELECT digest FROM top WHERE n = 1) AS verified
FROM numbered n JOIN ends e ON e.doc = n.doc JOIN subroots s ON s.source IS NOT DISTINCT FROM n.source
"""
