"""Operators called from SQL by the names that the registry gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions.lineage import cut
from basalt.functions.registry import REGISTRY
from basalt.operators import graph, registry
from basalt.plans import tables as tb
from basalt.plans.catalog import BFS_SQL, query


def _installed(s):
    REGISTRY.install(s, replace=True)
    return s


@query("""select doc_id as patch_id, source as path, 1 as hunk, '-' || split_part(text, chr(10), 1) as line from documents where text is not null
union all select doc_id, source, 1, '+' || lang || ': ' || split_part(text, chr(10), 1) from documents where text is not null
union all select doc_id, lang, 2, ' ' || n_chars from documents where text is not null""")
def d01_patch_lines(s, d):
    """A patch of two files is made of every document: its first line is changed in one, its size stays in the other."""
    doc, first = tb.table(s, d, "documents").filter("text is not null"), F.element_at(F.split("text", "\n"), 1)
    change = F.concat(F.format_string("--- a/%s\n+++ b/%s\n@@ -1,1 +1,1 @@\n-", "source", "source"), first, F.lit("\n+"), "lang", F.lit(": "), first)
    same = F.format_string("\n--- a/%s\n+++ b/%s\n@@ -3 +3 @@\n %d\n", "lang", "lang", "n_chars")
    patches = doc.select(F.col("doc_id").alias("patch_id"), F.concat(change, same).alias("text"))
    return _installed(s).sql("select patch_id, path, hunk, line from patch_lines(table({patches}))", patches=patches)


@query(BFS_SQL.format(graph=tb.GRAPH_SQL, start="name = 'R:1'", depth=2, types="") + " select name, min(hops)::bigint as hops from walk group by name")
def d01_reached(s, d):
    """Spark ends recursions of more than a million rows, of which there is one for each walk here; the limit is lifted while the query runs."""
    graph.both_ways(tb.graph(s, d)[1]).select(F.col("a").alias("name"), F.col("b").alias("other")).createOrReplaceTempView("links")
    key, before = "spark.sql.cteRecursionRowLimit", s.conf.get("spark.sql.cteRecursionRowLimit")
    s.conf.set(key, -1)
    try:
        return cut(_installed(s).sql("select name, cast(hops as bigint) as hops from reached('R:1', 2)"))
    finally:
        s.conf.set(key, before)


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings")
def d01_cosine(s, d):
    tb.vectors(s, d).selectExpr("ref_id as vec_id", "cast(vector as array<double>) as vector").createOrReplaceTempView("called_vectors")
    return _installed(s).sql("select v.vec_id, round(cosine(v.vector, q.vector), 6) as score from called_vectors v cross join (select vector from called_vectors where vec_id = 0) q")


@query("select doc_id, case when length(text) <= 30 then text else left(text, 29) || '…' end as head from documents")
def d02_clipped(s, d):
    tb.table(s, d, "documents").createOrReplaceTempView("called_documents")
    return _installed(s).sql("select doc_id, clipped(text, 30) as head from called_documents")


@query("select 'f' || p_partkey as name, p_type || case when p_partkey % 3 = 0 then chr(10) || chr(10) || p_brand else '' end as description from part")
def d05_described(s, d):
    """Every third function is told of further instructions."""
    p = tb.table(s, d, "part")
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name")
    return registry.described(p.select(name, F.col("p_type").alias("description")), p.filter("p_partkey % 3 = 0").select(name, F.col("p_brand").alias("text")))
