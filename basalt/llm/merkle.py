"""A Merkle tree over a table: per-language trees under one root, a proof for each row, and rows folded again along a recursive query."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, fold, shared_folder

#: So many consecutive nodes become one.
WIDTH = 8
#: So many consecutive runs of leaves share a salt; a node row is met by so many at most. A power of WIDTH, or it is cut into such powers evenly.
BLOCK = 256
#: Places within a partition take the lower bits of a row's number, partitions the bits above.
BITS = 33


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values one after another: ``-`` for a null, else the length in bytes, a colon and the value as text."""
    spelt = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in spelt)), 256)


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column tree) with their place within the tree, from 0, and the tree's number of rows, n.

    Rows are sorted over ranges and stored; each tree has a place to begin for every range that it is in,
    so a tree may hold any share of the rows.
    """
    stored = cut(rows.orderBy("tree", *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", BITS)
    ranges = stored.groupBy(F.col("tree").alias("of"), part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    ranges = ranges.selectExpr(
        "of", "part", "first - coalesce(sum(rows) over (partition by of order by part rows between unbounded preceding and 1 preceding), 0L) as base", "sum(rows) over (partition by of) as n"
    )
    return stored.join(ranges, (F.col("tree") == F.col("of")) & (part == F.col("part"))).withColumn("pos", F.col("at") - F.col("base")).drop("at", "of", "part", "base")


def _build(nodes: DataFrame, path: str) -> DataFrame:
    """Writes all nodes that have a parent as rows linked to it, level by level, and returns the trees' last nodes.

    ``nodes``: tree, level, pos, n (nodes of the tree at that level), digest, runs (runs of leaves below at most).
    A row in the files: the node, its parent, and the siblings' digests left and right of it.
    """
    spark, last, level = nodes.sparkSession, [], 0
    while True:
        done = nodes.filter("n = 1")
        last.append(done.select("tree", "level", "digest", "runs"))
        nodes = nodes.filter("n > 1")
        member = F.struct("pos", "digest", "runs")
        grouped = nodes.groupBy("tree", "level", F.expr(f"pos div {WIDTH}").alias("up_pos"), "n").agg(F.sort_array(F.collect_list(member)).alias("own"))  # WIDTH at most
        linked = grouped.select("*", F.sha2(F.concat_ws("", "own.digest"), 256).alias("up_digest"), F.posexplode("own").alias("i", "node")).selectExpr(
            "tree", "level", "node.pos as pos", "tree as up_tree", "level + 1 as up_level", "up_pos", "up_digest", f"cast(ceil(n / {WIDTH}) as long) as up_n", "node.digest as digest",
            "unhex(array_join(slice(own.digest, 1, i), '')) as before", "unhex(array_join(slice(own.digest, i + 2, size(own)), '')) as after", "node.runs as runs", "i", "array_max(own.runs) as up_runs",
        )
        here = f"{path}/at={level}"
        linked.write.parquet(here)
        back = spark.read.parquet(here)
        nodes = back.filter("i = 0").selectExpr("up_tree as tree", "up_level as level", "up_pos as pos", "up_n as n", "up_digest as digest", "up_runs as runs")
        level += 1
        if nodes.isEmpty():
            break
    whole = last[0]
    for more in last[1:]:
        whole = whole.unionByName(more)
    return whole


def manifest(df: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", tampered_mod: int = 3) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of the five columns. Per lang they ascend by doc_id (null first; rows of one
    doc_id by their digests), and every eight consecutive nodes become one until one remains, the
    subroot; subroots in the order of their lang, null first, likewise give the root. proof_sha256 is
    the digest of all siblings on the way up; folded_root is the root that the leaf of the tampered text
    gives with them. Rows are tampered with where ``tampered_mod`` divides the crc32 of the decimal doc_id
    (not where that is null): A-Z of their text are lower-cased. An empty table gives no rows; repeated
    rows stay. Other columns are not read, whatever their names.

    Levels are stored as node rows linked to their parents, which hold the siblings beside them. A
    recursive query climbs from the leaves: the eight leaves of a run share a row, as they share all
    siblings from the first level on; each tampered leaf is folded on its own, and so is the run as it was.
    Nodes near the root are on the way of all rows, so their rows are stored once for each block of
    runs below them, and no more than a block meets one node row. Spark's limit of rows in recursions is lifted while the query runs.
    """
    spark = df.sparkSession
    given = df.select(*(F.col(c).alias(a) for c, a in ((doc_id, "doc_id"), (source, "source"), (lang, "lang"), (n_chars, "n_chars"), (text, "text"))))
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    named = ["doc_id", "source", "lang", "n_chars"]
    leaf = leaf_digest([F.col(c) for c in (*named, "text")])
    touched = F.coalesce(fold("doc_id", tampered_mod) == 0, F.lit(False))
    leaves = given.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf.alias("leaf"),
        F.when(touched, leaf_digest([*(F.col(c) for c in named), lower])).otherwise(leaf).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = _ranked(cut(leaves), ["doc_id", "leaf", "row"])
    leaves = cut(leaves.select("tree", "doc_id", "leaf", "changed", "pos", "n"))

    path = shared_folder(spark, "nodes")
    own = leaves.selectExpr("tree", "0 as level", "pos", "n", "leaf as digest", f"cast(ceil(n / {WIDTH}) as long) as runs")
    subroots = cut(_build(own, f"{path}/below"))
    top = _ranked(subroots.withColumnsRenamed({"tree": "below", "level": "depth"}).withColumn("tree", F.lit("")), ["below"])
    top = cut(top.selectExpr("below", "depth", "tree", "0 as level", "pos", "n", "digest", "runs"))
    root = _build(top.drop("below", "depth"), f"{path}/above").select("digest").first()
    if root is None:
        return leaves.selectExpr("doc_id", "leaf", *(f"'' as {c}" for c in ("subroot", "root", "proof_sha256", "folded_root")), "true as verified")
    root = root["digest"]

    runs_of = cut(
        leaves.groupBy("tree", F.expr(f"pos div {WIDTH}").alias("run"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "changed"))).alias("own"))  # WIDTH at most
    )
    salts = max(1, runs_of.count() // BLOCK)
    climb = _climbed(runs_of, _node_rows(spark, path, top, salts), salts, root)

    # folds[0] is what the run gives as it was, the others are of its changed leaves in their order.
    fold_of = "lower(hex(folds[if(x.changed = x.leaf, 0, size(filter(slice(own, 1, i + 1), y -> y.changed != y.leaf)))]))"
    proof = "concat(array_join(transform(filter(own, (y, j) -> j != i), y -> y.leaf), ''), lower(hex(proof)))"
    one = f"transform(own, (x, i) -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'proof', {proof}, 'folded', {fold_of}))"
    rows = climb.join(runs_of, ["tree", "run"]).selectExpr("lower(hex(subroot)) as subroot", f"explode({one}) as x")
    return rows.select(
        "x.doc_id", "x.leaf", "subroot", F.lit(root).alias("root"), F.sha2("x.proof", 256).alias("proof_sha256"), F.col("x.folded").alias("folded_root"), (F.col("x.folded") == root).alias("verified")
    )


def _node_rows(spark, path: str, top: DataFrame, salts: int) -> DataFrame:
    """Nodes from the first level on with their parents and siblings, one row for each salt of the runs below them.

    A subroot is a leaf of the upper tree, so its row leads there.
    """
    below, above = (spark.read.parquet(f"{path}/{part}") for part in ("below", "above"))
    # A node of level k of a language's tree has the runs from pos * WIDTH^(k - 1) on below it.
    span = f"cast(power({WIDTH}, level - 1) as long)"
    blocks = lambda runs: f"least(greatest({runs} div {BLOCK}, 1L), {salts}L) as copies"
    upward = ["up_tree", "up_level", "up_pos", "before", "after"]
    inner = below.filter("level > 0").selectExpr(
        "tree", "level", "pos", *upward, "if(up_n = 1, unhex(up_digest), null) as subroot", f"(pos * {span}) div {BLOCK} as first", blocks(span)
    )
    joints = top.select("below", "depth", "pos").join(above.filter("level = 0").drop("tree", "level"), "pos")
    joints = joints.selectExpr("below as tree", "depth as level", "0L as pos", *upward, "cast(null as binary) as subroot", "0L as first", blocks(f"(runs + {BLOCK - 1})"))
    upper = above.filter("level > 0").selectExpr("tree", "level", "pos", *upward, "cast(null as binary) as subroot", "0L as first", blocks(f"(runs + {BLOCK - 1})"))
    whole = inner.unionByName(joints).unionByName(upper)
    return cut(whole.selectExpr("tree", "level", "pos", f"explode(transform(sequence(first, first + copies - 1), x -> x % {salts})) as salt", *upward, "subroot"))


def _climbed(runs_of: DataFrame, nodes: DataFrame, salts: int, root: str) -> DataFrame:
    """tree, run, subroot, folds (what each leaf of the run gives at the root) and proof (siblings above the run) of each run of leaves."""
    spark = runs_of.sparkSession
    changed = "transform(filter(own, x -> x.changed != x.leaf), x -> {})"
    single = f"concat(array(unhex(own[0].leaf)), {changed.format('unhex(x.changed)')})"
    node = "unhex(sha2(array_join(own.leaf, ''), 256))"
    several = f"concat(array({node}), {changed.format("unhex(sha2(array_join(transform(own, y -> if(x.pos = y.pos, y.changed, y.leaf)), ''), 256))")})"
    start = runs_of.selectExpr(
        "tree", "run", f"(run div {BLOCK}) % {salts} as salt", "tree as at_tree", "if(n = 1, 0, 1) as at_level", "run as at_pos", f"if(n = 1, {single}, {several}) as folds", "cast('' as binary) as proof",
        f"case when n = 1 then unhex(own[0].leaf) when n <= {WIDTH} then {node} end as subroot",
    )
    key, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(key, -1)
    try:
        return cut(
            spark.sql(
                """
                with recursive climb as (
                  select tree, run, salt, at_tree, at_level, at_pos, folds, proof, subroot from {start}
                  union all
                  select c.tree, c.run, c.salt, n.up_tree, n.up_level, n.up_pos,
                    transform(c.folds, f -> unhex(sha2(lower(hex(concat(n.before, f, n.after))), 256))),
                    concat(c.proof, n.before, n.after), coalesce(c.subroot, n.subroot)
                  from climb c join {nodes} n on c.at_tree = n.tree and c.at_level = n.level and c.at_pos = n.pos and c.salt = n.salt)
                select tree, run, folds, proof, subroot from climb
                left anti join {nodes} n on climb.at_tree = n.tree and climb.at_level = n.level and climb.at_pos = n.pos
                """,
                start=start,
                nodes=nodes,
            )
        )
    finally:
        spark.conf.set(key, before)
