"""Merkle manifest of a dataset: one tree per source, their roots under one root, proofs by pointer jumping.

Leaves are numbered in key order by ranges, so a source may hold any share of the rows. Sixteen consecutive nodes hash into
their parent, level by level; a level is one aggregate that shrinks sixteenfold. Every node holds a segment: the digests left
and right of it in its run, towards its parent. A self-join gives each node its ancestor's segment and the ancestor's own
pointer, which doubles the distance covered, until all nodes point at the root: log2(levels) joins, whatever the number of
rows. Leaves travel inside their run, so the joins run over a sixteenth of the rows. Many nodes share an ancestor near the
root; these lookups are salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import number_in_order
from panelcast.session import materialise

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tree of the sources' roots; sources are `n` (null) or `s` and their name, so bytewise order puts null first.
TOP = ""
WAYS = 64


def field_code(value: Column) -> Column:
    """`-` for null, else the byte count of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_code(c) for c in columns]).cast("binary"), 256)


def joined_digest(hashes: Column) -> Column:
    return F.sha2(F.concat_ws("", hashes).cast("binary"), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def runs_of(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Consecutive nodes (tree, idx, of, h) of one level in runs of sixteen: their digests in order, the run's digest and size.

    A tree of one node is done: its run passes the node's own digest on.
    """
    members = F.sort_array(F.collect_list(F.struct("idx", "h", *carried)))
    runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run"), "of").agg(members.alias("members"))
    hashes = F.col("members.h")
    return runs.withColumns({"h": F.when(F.col("of") == 1, hashes[0]).otherwise(joined_digest(hashes)), "kids": F.concat_ws("", hashes)})


def siblings(kids: Column, place: Column) -> Column:
    """The digests left and right of the node at `place` of its run."""
    return F.struct(F.substring(kids, F.lit(1), place * 64).alias("l"), F.substring(kids, place * 64 + 65, F.lit(64 * FANOUT)).alias("r"))


def climb(runs: DataFrame, level: int, label: str) -> tuple[DataFrame, DataFrame, int]:
    """All levels above the given runs: nodes that have a parent with their segment towards it, the roots (tree, h, level), the top level.

    `runs` are the nodes of `level` as (tree, run, of, h), `of` the size of the level below. The loop runs once a level: 16^levels rows.
    """
    nodes = runs.select("tree", F.col("run").alias("idx"), F.expr(f"(of + {FANOUT - 1}) div {FANOUT}").alias("of"), "h")
    parts, roots, sparks = [], [], nodes.sparkSession
    while True:
        nodes = materialise(nodes, f"{label}-level{level}")
        roots.append(nodes.filter("of = 1").select("tree", "h", F.lit(level).alias("level")))
        open_nodes = nodes.filter("of > 1")
        if open_nodes.isEmpty():
            break
        above = runs_of(open_nodes)
        inside = above.select("tree", "run", "kids", F.explode("members.idx").alias("idx"))
        parts.append(inside.select("tree", F.lit(level).alias("level"), "idx", F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("run").alias("up_idx"),
                                   F.array(siblings(F.col("kids"), (F.col("idx") % FANOUT).cast("int"))).alias("path")))
        nodes = above.select("tree", F.col("run").alias("idx"), F.expr(f"(of + {FANOUT - 1}) div {FANOUT}").alias("of"), "h")
        level += 1
    empty = sparks.createDataFrame([], "tree string, level int, idx long, up_tree string, up_level int, up_idx long, path array<struct<l:string,r:string>>")
    out = empty
    for p in parts:
        out = out.unionByName(p)
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return out, found, level


def jump(nodes: DataFrame, levels: int) -> DataFrame:
    """Pointer jumping: every node's path all the way to the root, after log2(levels) self-joins.

    A node at or under the root keeps its pointer where no ancestor has one. Each pass writes its table, so a lost executor
    costs one pass. An ancestor that most nodes point at is looked up by salt: at most WAYS of its rows go to the join.
    """
    reached, at = 1, ["up_tree", "up_level", "up_idx"]
    nodes = materialise(nodes, "jump0")
    while reached < levels:
        salted = nodes.withColumn("salt", F.pmod(F.xxhash64("tree", "level", "idx"), F.lit(WAYS)).cast("int"))
        wanted = salted.select(*at, "salt").distinct()
        above = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"),
                             F.struct(F.col("up_tree").alias("t"), F.col("up_level").alias("v"), F.col("up_idx").alias("i"), "path").alias("more"))
        found = wanted.join(above, at)
        nodes = salted.join(found, [*at, "salt"], "left").select(
            "tree", "level", "idx", F.coalesce("more.t", "up_tree").alias("up_tree"), F.coalesce("more.v", "up_level").alias("up_level"),
            F.coalesce("more.i", "up_idx").alias("up_idx"),
            F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more.path")).alias("path"))
        reached *= 2
        nodes = materialise(nodes, f"jump{reached}")
    return nodes


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """One row per row: key, `group`, leaf, other_leaf (of the row with its text lower-cased, for audits), subroot, root, place, path.

    `path` lists, from the leaf to the root, the digests left and right of the way. Null keys come first in their source, equal
    keys in the order of their leaves; repeated rows are leaves each. A source of one row is its leaf, a single source the
    root. Nulls in any field count as such; other columns are ignored. An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))
    changed = [tampered_text(F.col(c).cast("string")) if c == text else F.col(c) for c in fields]
    leaves = docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("h"), leaf_digest(changed).alias("other"))
    leaves = number_in_order(materialise(leaves, "leaves"), ["tree"], ["key", "h"], "idx", "ordered").withColumnRenamed("idx_of", "of")
    runs = materialise(runs_of(leaves, ["key", "other"]).select("tree", "run", "of", "members", "h", "kids"), "runs")
    spark = docs.sparkSession

    lower, roots, height = climb(runs, 1, "tree")
    subroots = materialise(roots, "subroots")
    # The sources' roots, in order, are the leaves of the top tree, at a level of their own.
    placed = materialise(number_in_order(subroots, [], ["tree"], "idx", "sources").withColumnRenamed("idx_of", "of"), "placed")
    top_runs = runs_of(placed.select(F.lit(TOP).alias("tree"), "idx", "of", "h", F.col("tree").alias("source"), "level"), ["source", "level"])
    top_runs = materialise(top_runs.select("tree", "run", "of", "members", "h", "kids"), "top")
    upper, root, top_height = climb(top_runs, 1, "top")
    # From a source's root into the top tree; with one source there is nowhere to go.
    bridge = top_runs.filter("of > 1").select("kids", "run", F.explode("members").alias("m")).select(
        F.col("m.source").alias("tree"), F.col("m.level").alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(TOP).alias("up_tree"),
        F.lit(1).alias("up_level"), F.col("run").alias("up_idx"), F.array(siblings(F.col("kids"), (F.col("m.idx") % FANOUT).cast("int"))).alias("path"))
    nodes = jump(lower.unionByName(upper).unionByName(bridge), height + top_height + 1)
    paths = nodes.filter(f"level = 1 and tree <> '{TOP}'").select("tree", F.col("idx").alias("run"), F.col("path").alias("above"))

    whole = runs.select("tree", "run", "of", "members", "kids").join(paths, ["tree", "run"], "left")
    no_path = F.expr("array()").cast("array<struct<l:string,r:string>>")
    out = whole.select("tree", "of", "kids", F.coalesce("above", no_path).alias("above"), F.explode("members").alias("m")).select(
        "tree", F.col("m.key").alias(key), F.col("m.idx").alias("place"), F.col("m.h").alias("leaf"), F.col("m.other").alias("other_leaf"),
        F.when(F.col("of") == 1, F.col("above")).otherwise(F.concat(F.array(siblings(F.col("kids"), (F.col("m.idx") % FANOUT).cast("int"))), "above")).alias("path"))
    named = with_subroots(out, subroots.select("tree", F.col("h").alias("subroot")))
    # One row: the digest of the whole dataset.
    top = root.agg(F.first("h")).first()[0]
    group_name = F.when(F.col("tree") != "n", F.substring("tree", 2, 1 << 30)).alias(group)
    return named.select(key, group_name, "leaf", "other_leaf", "subroot", F.lit(top).alias("root"), "place", "path")


def with_subroots(rows: DataFrame, subroots: DataFrame) -> DataFrame:
    """Adds its source's root to every row; a source of many rows is looked up by salt."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("tree", "place"), F.lit(WAYS)).cast("int"))
    spread = subroots.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    return salted.join(spread, ["tree", "__salt"]).drop("__salt")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["l"], p["r"]))).cast("binary"), 256)


def audit(tree: DataFrame, key: str = "doc_id", every: int = 5) -> DataFrame:
    """Checks every leaf against the root; where `every` divides the key's crc32 the tampered row takes the leaf's place."""
    checked = F.crc32(F.col(key).cast("string").cast("binary")) % every == 0
    leaf = F.when(F.coalesce(checked, F.lit(False)), F.col("other_leaf")).otherwise(F.col("leaf"))
    out = tree.select(key, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(leaf, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
