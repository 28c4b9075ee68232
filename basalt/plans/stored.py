"""Queries over what is stored: collections behind a data source, and indexes for near vectors and for text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.lineage import shared_path
from basalt.operators import near, trigrams
from basalt.plans import tables as tb
from basalt.plans.catalog import query
from basalt.sources import collections, office


def _stored(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A new store with a collection for each label and three tenants in each, and the entries that it was filled with."""
    path = shared_path(s, "collections")
    e = tb.table(s, d, "embeddings")
    rows = e.select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"), F.concat(F.lit("t"), (F.col("vec_id") % 3).cast("string")).alias("tenant"), F.col("vec_id").cast("string").alias("ref_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    for r in rows.groupBy("collection", "tenant").agg(F.max(F.size("vector")).alias("n")).collect():  # a row for each tenant
        collections.create(path, r["collection"], r["n"], r["tenant"])
    collections.add(rows, path)
    return path, rows


STORED_SQL = "e as (select 'c' || label as collection, 't' || vec_id % 3 as tenant, vec_id::varchar as ref_id, 'vector ' || vec_id as text, embedding::double[] as vector, vec_id from embeddings)"


@query(f"with {STORED_SQL} select collection, ref_id, text, round(list_sum(vector), 6) as total from e where tenant = 't1'")
def s10_tenant_scan(s, d):
    """All collections of one tenant: only its files are read."""
    own = collections.read(s, _stored(s, d)[0]).filter("tenant = 't1'")
    return own.select("collection", "ref_id", "text", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"with {STORED_SQL} select collection, tenant, ref_id, case when vec_id % 5 = 0 then 'written again' else text end as text from e")
def s11_stored_entries(s, d):
    """Every fifth entry is written a second time and takes the place of the first."""
    path, rows = _stored(s, d)
    collections.add(rows.filter("cast(ref_id as long) % 5 = 0").withColumn("text", F.lit("written again")), path)
    return collections.read(s, path).select("collection", "tenant", "ref_id", "text")


@query(f"with {STORED_SQL} select collection, tenant, count(*) as n, min(vec_id) as least, max(vec_id) as most from e where vec_id % 4 <> 1 group by all")
def s12_stored_removals(s, d):
    """What is left of each tenant when every fourth entry is removed."""
    path, rows = _stored(s, d)
    collections.remove(rows.filter("cast(ref_id as long) % 4 = 1"), path)
    n = F.col("ref_id").cast("long")
    return collections.read(s, path).groupBy("collection", "tenant").agg(F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))


def _indexed(s: SparkSession, d: str, **how) -> tuple[str, DataFrame]:
    path, v = shared_path(s, "near"), tb.vectors(s, d)
    near.build(v, path, **how)
    return path, v


def _asked(v: DataFrame) -> DataFrame:
    return v.filter("ref_id % 50 = 0").select(F.col("ref_id").alias("query_id"), "vector")


NEAR_SQL = """select query_id, ref_id, round(score, 6) as score, rank from (
  select q.vec_id as query_id, v.ref_id, list_cosine_similarity(v.vector, q.embedding::double[]) as score,
    row_number() over (partition by q.vec_id order by list_cosine_similarity(v.vector, q.embedding::double[]) desc, v.ref_id) as rank
  from ({}) v, embeddings q where q.vec_id % 50 = 0) where rank <= 10"""


@query(NEAR_SQL.format("select vec_id::varchar as ref_id, embedding::double[] as vector from embeddings"))
def t03_all_cells(s, d):
    """The index asked in all its cells, with exact scores: as exact search."""
    path, v = _indexed(s, d)
    found = near.search(s, path, _asked(v), 10, None, None)
    return found.select("query_id", "ref_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(NEAR_SQL.format("""select vec_id::varchar as ref_id, case when vec_id % 7 = 3 then list_reverse(embedding::double[]) else embedding::double[] end as vector from embeddings where vec_id % 9 <> 5"""))
def t03_changed_index(s, d):
    """Every seventh vector is written anew and every ninth removed, without building again."""
    path, v = _indexed(s, d)
    turned = v.filter("ref_id % 7 = 3 and ref_id % 9 <> 5").select("ref_id", F.reverse("vector").alias("vector"))
    near.upsert(turned, path, v.filter("ref_id % 9 = 5"))
    found = near.search(s, path, _asked(v), 10, None, None)
    return found.select("query_id", "ref_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def t03_near_cells(s, d):
    """The ten best found in a few cells by their codes, then scored exactly; how many are found is measured by the tests."""
    path, v = _indexed(s, d)
    return near.search(s, path, _asked(v), 10)


query()(t03_near_cells)


def _text_index(s: SparkSession, d: str) -> str:
    path = shared_path(s, "trigrams")
    trigrams.build(tb.files(s, d), path)
    return path


LINES_SQL = f"with {tb.FILES_SQL}, l as (select path, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as lineno from files)"


@query(LINES_SQL + " select path, lineno, left(text, 500) as text from l where regexp_matches(text, '(?i)li(cen[cs]e|mited)d?[ .]')")
def f17_indexed_grep(s, d):
    found = trigrams.grep(s, _text_index(s, d), "(?i)li(cen[cs]e|mited)d?[ .]", most=None)
    return found.select("path", F.col("lineno").cast("long").alias("lineno"), "text")


@query(LINES_SQL + " select path, lineno from l where regexp_matches(text, '[Rr]eleased .*the (MIT|Apache) |der [a-z]+ung') qualify row_number() over (partition by path order by lineno) <= 2")
def f18_indexed_per_file(s, d):
    found = trigrams.grep(s, _text_index(s, d), "[Rr]eleased .*the (MIT|Apache) |der [a-z]+ung", most=None, per_file=2)
    return found.select("path", F.col("lineno").cast("long").alias("lineno"))


@query(f"with {tb.FILES_SQL} select path, length(content) as size from files where contains(lower(content), 'apache')")
def f03_indexed_keyword(s, d):
    return trigrams.holding(s, _text_index(s, d), "APache").select("path", F.length("content").cast("long").alias("size"))


@query(r"""with d as (select doc_id, doc_id || case doc_id % 3 when 0 then '.docx' when 1 then '.xlsx' else '.pptx' end as path, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') as t from documents),
x as (select path, case when doc_id % 3 = 1 then '## Sheet1' || chr(10) || t else t end as text from d)
select path, text, case when length(regexp_replace(text, '\s', '', 'g')) < 50 then 'scant' else 'ok' end as status from x""")
def s21_office_text(s, d):
    """Every document is written as a file of one of three kinds, in 512 folders, and the files are read."""
    root, doc = shared_path(s, "office"), tb.table(s, d, "documents")
    suffix = F.element_at(F.array(F.lit(".docx"), F.lit(".xlsx"), F.lit(".pptx")), (F.col("doc_id") % 3 + 1).cast("int"))
    folder = F.pmod(F.hash("doc_id"), F.lit(512)).cast("string")
    office.write(doc.select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"), "text"), root)
    found = office.extracted(office.listed(s, root))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("path"), "text", "status")
