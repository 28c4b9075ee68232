"""Searches by mode, rendered snapshots, persisted collections and other operators as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as tx
from basalt.operators import activity, dependencies, edits, mailbox, mutate, ranking, rendering, search, timers, vectors
from basalt.plans import tables as tb
from basalt.plans.catalog import HITS_SQL, TIMER_NOW, TIMER_SQL, _collections, _hits, query
from basalt.functions.lineage import shared_path
from basalt.sources import embed, files


@query("select 'c' || label as collection, vec_id::varchar as ref_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm from embeddings where label < 8")
def s07_dumped_and_restored(s, d):
    rows, registry = _collections(s, d)
    again = vectors.restored(vectors.dumped(vectors.add(s.createDataFrame([], vectors.SCHEMA), rows, registry)[0]))
    return again.select("collection", "ref_id", F.round("norm", 6).alias("norm"))


@query("select n_nationkey, n_name || chr(10) as content, length(n_name) + 1 as size from nation")
def s14_whole_files(s, d):
    path = shared_path(s, "tree")
    n = tb.table(s, d, "nation").select("n_nationkey", "n_name")
    n.write.partitionBy("n_nationkey").text(path)
    tree = files.read_tree(s, path, "*.txt")
    return tree.select(F.regexp_extract("path", r"^n_nationkey=(\d+)/", 1).cast("int").alias("n_nationkey"), "content", "size")


@query("select 'c' || label as collection, vec_id::varchar as ref_id from embeddings where label < 8 and label <> 2 and not (label = 1 and vec_id % 2 = 0)")
def s30_persisted_after_changes(s, d):
    """Two collections change, one of them to nothing; the others' files are not written again."""
    path = shared_path(s, "vectors.parquet")
    rows, registry = _collections(s, d)
    vectors.save(vectors.add(s.createDataFrame([], vectors.SCHEMA), rows, registry)[0], path)
    stored = vectors.load(s, path)
    gone = stored.filter("collection = 'c2' or collection = 'c1' and cast(ref_id as long) % 2 = 0").select("collection", "ref_id")
    vectors.persist(vectors.remove(stored, gone), path, ["c1", "c2"])
    return vectors.load(s, path).select("collection", "ref_id")


@query(f"with {tb.FILES_SQL} select path, 'deleted' as done from files where mtime % 5 = 0 union all select 'none/' || n_nationkey, 'not found' from nation")
def s31_deleted_or_missing(s, d):
    f = tb.files(s, d)
    asked = f.filter("unix_timestamp(mtime) % 5 = 0").select("path").unionByName(tb.table(s, d, "nation").select(F.format_string("none/%d", "n_nationkey").alias("path")))
    return files.deleted_or_missing(f, asked)[1]


@query("select distinct 'nation/' || c_nationkey as path from customer union select 'region/' || r_regionkey from region")
def s31_made_folders(s, d):
    there = tb.table(s, d, "region").select(F.format_string("region/%d", "r_regionkey").alias("path"))
    asked = tb.table(s, d, "customer").select(F.format_string("nation/%d", "c_nationkey").alias("path"))
    return files.make_dirs(there, asked.unionByName(there))


STATUS_SQL = """ev as (select 'c' || user_id % 7 as collection, case when event_type = 'view' then 2 else -1 end as n, event_type, event_id from events where event_type in ('view', 'click', 'error')),
st as (select collection, greatest(0, sum(n))::bigint as pending, case when arg_max(event_type, event_id) = 'error' then 'error' when sum(n) > 0 then 'indexing' else 'ready' end as status from ev group by 1)"""


def _statuses(s, d):
    kind = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "error", "failed").otherwise("done")
    ev = tb.table(s, d, "events").filter("event_type in ('view', 'click', 'error')")
    ev = ev.select(F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("collection"), kind.alias("kind"), F.when(F.col("event_type") == "view", 2).otherwise(1).alias("n"), F.col("event_id").alias("ord"))
    return vectors.indexing_status(ev)


@query(f"""with {STATUS_SQL}, q as (select embedding::double[] as x from embeddings where vec_id = 0),
h as (select label, vec_id, list_cosine_similarity(embedding::double[], x) as score, row_number() over (partition by label order by list_cosine_similarity(embedding::double[], x) desc, vec_id) as rank from embeddings, q where label in (1, 8))
select 'c' || label as collection, vec_id::varchar as ref_id, round(score, 6) as score, coalesce(st.status, 'ready') as status, coalesce(st.pending, 0) as pending
from h left join st on st.collection = 'c' || label where rank <= 5""")
def t04_search_with_status(s, d):
    """Two collections, one with a status and one without; a third, whose backend is away, gives no rows."""
    rows, _ = _collections(s, d)
    q, statuses = tb.query_vector(s, d), _statuses(s, d)
    found = vectors.search_collection(rows, statuses, "c1", q, 5).unionByName(vectors.search_collection(rows, statuses, "c8", q, 5))
    found = found.unionByName(vectors.search_collection(rows, statuses, "c2", q, 5, available=False))
    return found.select("collection", "ref_id", F.round("score", 6).alias("score"), "status", F.col("pending").cast("long").alias("pending"))


def _graph_hits(s, d, k):
    """Vector hits that point at customers."""
    return _hits(s, d, k).select(F.concat(F.lit("C:"), F.col("ref_id").cast("string")).alias("ref_id"), F.round("score", 9).alias("score"), "rank")


GRAPH_HITS_SQL = f"""{HITS_SQL}, {tb.GRAPH_SQL}, vh as (select 'C:' || ref_id as ref_id, round(score, 9) as score, rank from hits),
kw as (select name as ref_id, 'entity' as kind, ord from e where contains(lower(name), 'build') or contains(lower(description), 'build') or contains(lower(entity_type), 'build')
  union all select a || '>' || b, 'relation', substr(a, 3)::bigint * 1000000 + substr(b, 3)::bigint * 4 from r where contains(lower(t), 'build'))"""


@query(f"""with {GRAPH_HITS_SQL} select ref_id, kind, row_number() over (order by kind, ord) as place from kw qualify place <= 12""")
def t06_keyword_mode(s, d):
    return search.search_graph(*tb.graph(s, d), "Build", "keyword", 12).hits.select("ref_id", "kind", "place").unionByName(
        search.search_graph(*tb.graph(s, d), "no such words", "keyword", 12).hits.select("ref_id", "kind", "place")
    )


@query(f"with {GRAPH_HITS_SQL} select ref_id, round(score, 6) as score, rank as place from vh where rank <= 15 and score >= 0.1 and ref_id in (select name from e)")
def t06_vector_mode(s, d):
    found = search.search_graph(*tb.graph(s, d), "", "vector", 15, 0.1, _graph_hits(s, d, 15))
    return found.hits.select("ref_id", F.round("score", 6).alias("score"), "place")


@query(f"""with {GRAPH_HITS_SQL}, v as (select * from vh where rank <= 10 and score >= 0), w as (select ref_id, row_number() over (order by kind, ord) as o from kw qualify o <= 10),
m as (select coalesce(v.ref_id, w.ref_id) as ref_id, case when v.ref_id is null then 1.0::double when w.ref_id is null then score else score + 0.5 end as score, rank, o from v full join w on v.ref_id = w.ref_id),
p as (select *, row_number() over (order by score desc, rank nulls last, o) as place from m where score >= 0.2 qualify place <= 10)
select ref_id, round(score, 6) as score, place from p where ref_id in (select name from e) or ref_id in (select a || '>' || b from r)""")
def t06_hybrid_mode(s, d):
    found = search.search_graph(*tb.graph(s, d), "build", "hybrid", 10, 0.2, _graph_hits(s, d, 20))
    return found.hits.select("ref_id", F.round("score", 6).alias("score"), "place")


@query(f"""with {GRAPH_HITS_SQL}, h as (select ref_id as name from vh where rank <= 5 and score >= 0 and ref_id in (select name from e))
select 'edge' as kind, a || '>' || b as ref_id from r where a in (from h) or b in (from h)
union all select distinct 'neighbour', b from u where a in (from h) and b not in (from h)""")
def t06_around_vector_hits(s, d):
    found = search.search_graph(*tb.graph(s, d), "", "vector", 5, 0.0, _graph_hits(s, d, 5), neighbours=True, edges=True)
    edge = found.edges.select(F.lit("edge").alias("kind"), "ref_id")
    return edge.unionByName(found.neighbours.select(F.lit("neighbour").alias("kind"), F.col("name").alias("ref_id")))


@query(f"""with {tb.GRAPH_SQL} select 'entity' as kind, name as ref_id from e where contains(lower(name || '|' || description || '|' || entity_type), 's:1')
union all select 'relation', a || '>' || b from r where contains(lower(t || '|' || a || '|' || b), 's:1')""")
def u02_entities_and_relations(s, d):
    return ranking.keyword_hits(*tb.graph(s, d), "S:1", None).select("kind", "ref_id")


@query(f"""with {HITS_SQL}, {tb.BOARD_SQL}, v as (select ref_id, score from hits where rank <= 15 and score >= 0.2)
select id, 'merged' as run, round(case when v.ref_id is null then 1.0::double when contains(lower(description), 'low') then greatest(1.0, v.score) else v.score end, 6) as score from tasks left join v on v.ref_id = id where v.ref_id is not null or contains(lower(description), 'low')
union all select id, 'keyword', 1.0 from tasks where contains(lower(description), 'low')""")
def t09_merged_or_keyword_alone(s, d):
    """With vector hits, the best k and of these those at the threshold are merged; where they could not be had, keywords stand alone."""
    t = tb.board(s, d)
    both = ranking.hybrid_board(t, "LOW", _hits(s, d, 15), 15, 0.2).select("id", F.lit("merged").alias("run"), F.round("score", 6).alias("score"))
    return both.unionByName(ranking.hybrid_board(t, "LOW", None, 15, 0.2).select("id", F.lit("keyword").alias("run"), F.round("score", 6).alias("score")))


def _needs(s, d):
    """Parts as steps: each needs the ones at a half and at a third of its number."""
    p = tb.table(s, d, "part").select(F.col("p_partkey").alias("k"))
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    deps = p.select("k", F.explode(F.array(F.floor(F.col("k") / 2), F.floor(F.col("k") / 3))).alias("n")).filter("n > 0")
    return p.select(name(F.col("k")).alias("name"), F.col("k").alias("ord")), deps.select(name(F.col("k")).alias("name"), name(F.col("n")).alias("needs"))


@query("select 'P' || p_partkey as name, p_partkey + 1 as place from part")
def t12_order_of_release(s, d):
    """A half's number is never below a third's, so parts are released in the order of their numbers."""
    return dependencies.levels(*_needs(s, d)).select("name", "place")


#: The owners of a board and their places, and what is told of each.
OWNERS_SQL = """c as (select coalesce(nullif(owner, ''), 'unassigned') as o, count(*) as n from tasks group by 1), owners as (select o || ': ' || n as told, row_number() over (order by o = 'unassigned', o) as i from c)"""


@query(f"with {tb.BOARD_SQL}, {OWNERS_SQL} select (i - 1) // 1000 as part, string_agg(case when i = 1 then '' else ' | ' end || told, '' order by i) as text from owners group by 1")
def a02_breakdown(s, d):
    return rendering.owner_counts(tb.board(s, d))


@query(f"with {tb.FILES_SQL}, x as (select path, string_split(rtrim(content, chr(10)), chr(10)) as s from files) select path, i as lineno, rpad(i::varchar, 6, ' ') || s[i] as line from (select path, s, unnest([2::bigint, 3]) as i from x) where i <= len(s)")
def w04_numbered_lines(s, d):
    return files.numbered_lines(tb.files(s, d), 2, 2).select("path", F.col("lineno").cast("long").alias("lineno"), "line")


@query("""select c_name as path, case when c_custkey % 2 = 0 then 'a' || chr(10) || 'B' || chr(10) || 'c' || chr(10) || 'D' || chr(10) || 'E' || chr(10) else 'new' || chr(10) end as content from customer""")
def m18_one_file_patches(s, d):
    """Two hunks that move lines, and a patch that only adds, which makes its file."""
    n = tb.table(s, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    f = n.filter(even).select(F.col("c_name").alias("path"), F.lit("a\nb\nc\nd\n").alias("content"), F.lit(8).cast("long").alias("size"), F.timestamp_seconds("c_custkey").alias("mtime"))
    change = F.format_string("--- a/%s\n+++ b/%s\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n@@ -4,1 +4,2 @@\n-d\n+D\n+E\n", "c_name", "c_name")
    make = F.format_string("--- /dev/null\n+++ b/%s\n@@ -0,0 +1 @@\n+new\n", "c_name")
    return edits.patched(n.select(F.col("c_custkey").alias("patch_id"), F.when(even, change).otherwise(make).alias("text")), f)[0].select("path", "content")


@query("select c_custkey as template_id, 'field' || c_custkey as field from customer where c_custkey % 3 = 0")
def x05_unknown_fields(s, d):
    n = tb.table(s, d, "customer")
    template = F.concat(F.lit("{c_name} {{no}} {"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("field"), F.col("c_custkey").cast("string"))).otherwise("c_nationkey"), F.lit("}"))
    columns = s.createDataFrame([(c,) for c in n.columns], "name string")
    return tx.unknown_fields(n.select(F.col("c_custkey").alias("template_id"), template.alias("template")), columns)


@query("""with t as (select c_custkey as k from customer)
select k as prompt_id, 'text' as kind, 'see ' as value from t union all select k, 'text', ' and' from t where k % 4 <> 3 union all select k, 'text', ' ' from t where k % 4 = 3 union all select k, 'text', '' from t where k % 4 = 3
union all select k, 'image', 'pics/' || k || '/' || i || '.PNG' from t, (values (0), (1)) v(i) where k % 4 = 0
union all select k, 'document', '!!' || k || '.pdf[=> Use workspace_read tool]' from t where k % 4 = 1
union all select k, 'error', '!!none/*.jpg[Error: no image found in the workspace]' from t where k % 4 = 2
union all select k, 'image', 'pics/' || (k - 3) || '/' || i || '.PNG' from t, (values (0), (1)) v(i) where k % 4 = 3
union all select k, 'error', '!!x.png[Error: no image found in the workspace]' from t where k % 4 = 3""")
def x11_media_references(s, d):
    n, k = tb.table(s, d, "customer"), F.col("c_custkey")
    images = n.filter(k % 4 == 0).select(F.explode(F.array(F.format_string("pics/%d/0.PNG", k), F.format_string("pics/%d/1.PNG", k), F.format_string("pics/%d/notes.pdf", k))).alias("path"))
    paths = images.unionByName(n.filter(k % 4 == 1).select(F.format_string("docs/%d.pdf", k).alias("path"))).unionByName(n.select(F.format_string("none/%d.txt", k).alias("path")))
    ref = F.when(k % 4 == 0, F.format_string("!!pics/%d/* and", k)).when(k % 4 == 1, F.format_string("!!**/%d.pdf and", k)).when(k % 4 == 2, "!!none/*.jpg and").otherwise(F.format_string('!!"pics/%d/?.png" !!x.png', k - 3))
    prompts = n.select(k.alias("prompt_id"), F.concat(F.lit("see "), ref).alias("text"))
    return files.media_references(prompts, paths).select("prompt_id", "kind", "value")


@query(f"with {tb.FILES_SQL}, x as (select path, string_split(content, chr(10)) as s from files where contains(content, chr(10))) select path, length(s[1]) + 2 as start, length(s[2]) + case when len(s) > 2 then 1 else 0 end as length from x where s[2] <> ''")
def x25_back_to_original_lines(s, d):
    """The second line is found in a text with its blanks squeezed, and its place in the original is by lines."""
    f = tb.files(s, d).filter(F.contains("content", F.lit("\n")))
    second = F.split("content", "\n")[1]
    f = f.withColumn("second", second).filter("second <> ''").withColumn("normal", F.regexp_replace("content", "[ \t]+", " "))
    start = F.length(F.split("normal", "\n")[0]) + 2
    place = edits.by_line_count(F.col("content"), F.col("second"), F.col("normal"), start)
    return f.select("path", place.alias("m")).select("path", F.col("m.start").cast("long").alias("start"), F.col("m.length").cast("long").alias("length"))


@query("select event_id, ts - case when event_id % 3 = 0 then interval 2 hour else interval 0 hour end as at from events")
def x27_as_utc(s, d):
    """Times as text: with an offset, with the letter Z, and without either."""
    zone = F.when(F.col("event_id") % 3 == 0, "+02:00").when(F.col("event_id") % 3 == 1, "Z").otherwise("")
    ev = tb.table(s, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone).alias("said"))
    return ev.select("event_id", tx.as_utc("said").cast("timestamp_ntz").alias("at"))


@query(f"with {TIMER_SQL} select id, fire_at <= now as due, fire_at < now - interval 300 second as stale, round(epoch(now)::double - epoch(fire_at)::double, 3) as late from t, now")
def x28_due_and_stale(s, d):
    t, now = tb.timers(s, d), F.expr(TIMER_NOW)
    at = F.col("fire_at")
    return t.select(F.col("notification_id").alias("id"), timers.due(at, now).alias("due"), (at < timers.cut_off(now, 300)).alias("stale"), F.round(timers.seconds(now, at), 3).alias("late"))


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'b,c' else 'a,b,a,c' end as after, c_custkey % 2 <> 0 as has_a, case when c_custkey % 2 = 0 then 'b,c' else 'a,b,c' end as sorted from customer""")
def x31_array_changes(s, d):
    n = tb.table(s, d, "customer")
    text = lambda c: F.array_join(c, ",")
    gone = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a")))
    rows = n.withColumn("o", mutate.after_observations(F.array(*map(F.lit, "aba")), F.array(F.lit("c")), gone))
    return rows.select("c_custkey", text("o").alias("after"), F.array_contains("o", "a").alias("has_a"), text(F.array_sort(F.array_distinct("o"))).alias("sorted"))


@query(f"with {tb.BOARD_SQL} select creator, count(*) filter (status = 'F') as f, count(*) filter (status = 'O') as o, count(*) filter (status = 'P') as p from tasks group by creator")
def x32_counts_as_a_map(s, d):
    rows = rendering.counts_map(tb.board(s, d), "creator", "status")
    of = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0)).cast("long").alias(k.lower())
    return rows.select("creator", of("F"), of("O"), of("P"))


@query(f"""with {tb.BOARD_SQL}, t as (select *, coalesce(nullif(owner, ''), 'unassigned') as o from tasks)
select id, 'ID ' || id || ' [' || status || '] → [done] (Owner: ' || case when id % 6 = 0 then 'Z' else o end || ').' as sentence from t where id % 2 = 0
union all select id, 'ID ' || id || ' owner: ' || o || ' → Z.' from t where id % 3 = 0 union all select id, 'ID ' || id || ' output cleared.' from t where id % 5 = 0""")
def x36_sentences_of_changes(s, d):
    t, k = tb.board(s, d), F.col("id")
    after = t.withColumn("status", F.when(k % 2 == 0, "done").otherwise(F.col("status"))).withColumn("owner", F.when(k % 3 == 0, "Z").otherwise(F.col("owner")))
    return rendering.moves(t, after.withColumn("output", F.when(k % 5 == 0, "").otherwise(F.col("output")))).select("id", "sentence")


@query("""select c_custkey, '**Context update ' || c_custkey || '** — ' || case when c_custkey % 2 = 0 then 'current state.' else 'state has changed since the last update.' end || chr(10) || chr(10) || c_name
  || case when c_custkey % 3 = 0 then '' else chr(10) || chr(10) || 'more' end as text from customer""")
def x37_numbered_blocks(s, d):
    n = tb.table(s, d, "customer")
    sections = F.when(F.col("c_custkey") % 3 == 0, F.array("c_name")).otherwise(F.array("c_name", F.lit("more")))
    return n.select("c_custkey", rendering.block("c_custkey", sections, F.col("c_custkey") % 2 == 0).alias("text"))


@query(f"""with {tb.MAILBOX_SQL} select msg_id, case when sender = 'system' then 'unknown' else sender end as sender, case when sender = 'user' then '<' || type || '>' else content end as text from mail""")
def x38_defaults(s, d):
    m = tb.mailbox(s, d).withColumn("content", F.when(F.col("sender") == "user", "").otherwise(F.col("content")))
    m = m.withColumn("sender", F.when(F.col("sender") == "system", F.lit(None)).otherwise(F.col("sender")))
    return m.select("msg_id", mailbox.sender_name().alias("sender"), activity.message_text("content", "type").alias("text"))


LINE_SQL = "'- ID ' || id || ' [' || status || '] ' || description || ' (Owner: ' || coalesce(nullif(owner, ''), 'unassigned') || ', Creator: ' || creator || ')'"


@query(f"""with {tb.BOARD_SQL}, {OWNERS_SQL}, own as (select {LINE_SQL} as told, row_number() over (order by ord) as i from tasks where owner = 'C3' or (owner <> '' and creator = 'C3')),
items as (
  select 0 as section, 0 as i, '**Team planning:** ' || (select count(*) from tasks) || ' tasks total' as told
  union all select 1, i, case when i = 1 then chr(10) || 'Owners: ' else ' | ' end || told from owners
  union all select 2, 0, chr(10) || chr(10) || '**Your tasks** (owner or creator: C3):' union all select 3, i, chr(10) || told from own
  union all select 4, 0, chr(10) || chr(10) || 'Use get_planning_task(id) for exact ID lookup or search_planning(...) to filter tasks.'),
n as (select told, row_number() over (order by section, i) as k from items)
select 'C3' as me, (k - 1) // 1000 as part, string_agg(told, '' order by k) as text from n group by part
union all select 'nobody', 0, '**Team planning:** ' || (select count(*) from tasks) || ' tasks total' || chr(10) || 'Owners: ' || (select string_agg(told, ' | ' order by i) from owners) || chr(10) || chr(10) || 'No tasks assigned to or created by nobody yet.'
  || chr(10) || chr(10) || 'Use get_planning_task(id) for exact ID lookup or search_planning(...) to filter tasks.'
union all select 'none', 0, 'No current team planning.'""")
def x39_board_text(s, d):
    t = tb.board(s, d).withColumn("output", F.lit(""))
    shown = [rendering.board_text(t, "C3"), rendering.board_text(t, "nobody"), rendering.board_text(t.filter("false"), "C3")]
    out = [x.select(F.lit(me).alias("me"), "part", "text") for me, x in zip(("C3", "nobody", "none"), shown)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""with {tb.GRAPH_SQL} select 'graph' as of, 0 as part, '**Knowledge Graph Summary:**' || chr(10) || 'Entities: ' || (select count(*) from e) || ' | Relations: ' || (select count(*) from r) || chr(10)
  || 'Entity types: ' || (select string_agg(distinct entity_type, ', ' order by entity_type) from e) || chr(10) || 'Relation types: ' || (select string_agg(distinct t, ', ' order by t) from r) || chr(10)
  || 'Root entities:' || chr(10) || (select string_agg('- ' || name || ' (' || entity_type || '): ' || description, chr(10) order by ord) from e where is_root) || chr(10) || chr(10) || 'Use the get_graph tool to explore the full graph or subgraphs.' as text
union all select 'nothing', 0, 'Knowledge graph is empty.'""")
def x39_graph_text(s, d):
    e, r = tb.graph(s, d)
    none = rendering.graph_text(e.filter("false"), r.filter("false"))
    return rendering.graph_text(e, r).select(F.lit("graph").alias("of"), "part", "text").unionByName(none.select(F.lit("nothing").alias("of"), "part", "text"))


#: A text of lines, each with its place from 1, in parts of 1,000 lines, under a head.
PARTS_SQL = """select (i - 1) // 1000 as part, string_agg(case when i = 1 then '{}' else '' end || chr(10) || told, '' order by i) as text from x group by 1"""


@query("with x as (select c_name || ' (role: ' || c_mktsegment || ')' || case when c_custkey = 4 then ' - [you]' else '' end as told, row_number() over (order by c_custkey) as i from customer) " + PARTS_SQL.format("**Here is the team member list by name (and role):**"))
def x39_roster_text(s, d):
    c = tb.table(s, d, "customer")
    members = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), (F.col("c_custkey") == 4).alias("is_self"), F.col("c_custkey").alias("ord"))
    return rendering.roster_text(members).unionByName(rendering.roster_text(members.filter("false")))


@query("with x as (select p_name || ': ' || p_type || ' (Skills: ' || case when p_partkey % 2 = 0 then p_brand || ', s' || p_size else 'none' end || ')' as told, row_number() over (order by p_partkey) as i from part) " + PARTS_SQL.format("**Here is the available team role list (for hiring):**"))
def x39_roles_text(s, d):
    p = tb.table(s, d, "part")
    skill = F.when(F.col("p_partkey") % 2 == 0, F.array(F.col("p_brand"), F.concat(F.lit("s"), F.col("p_size").cast("string")))).otherwise(F.array().cast("array<string>"))
    roles = p.select(F.col("p_name").alias("role"), F.col("p_type").alias("description"), skill.alias("skills"), F.col("p_partkey").alias("ord"))
    return rendering.roles_text(roles).unionByName(rendering.roles_text(roles.filter("false")))


@query("""select conv_id || '-' || turn as message_id, 0 as part, 0 as item, text from conversations where role = 'user' and turn % 2 = 0
union all select conv_id || '-' || turn, 0, i, text || i from conversations, (values (0), (2)) v(i) where role = 'user' and turn % 2 <> 0""")
def x41_user_texts(s, d):
    """Prompts with one text, prompts of a text, an image and a text, and after each a tool's return; the model's answers count for nothing."""
    c, text = tb.table(s, d, "conversations"), F.col("text")
    item = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    items = F.array(item("text", F.concat(text, F.lit("0"))), item("image", F.lit("x")), item("text", F.concat(text, F.lit("2"))))
    part = lambda kind, content, own: F.struct(kind.alias("kind"), content.alias("content"), own.alias("items"))
    odd = F.col("turn") % 2 != 0
    prompt = part(F.when(F.col("role") == "system", "system").otherwise("user"), F.when(~odd, text), F.when(odd, items))
    tool = part(F.lit("tool"), text, F.when(F.lit(False), items))
    messages = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.when(F.col("role") == "assistant", "response").otherwise("request").alias("kind"), F.array(prompt, tool).alias("parts"))
    return rendering.user_texts(messages)


def _entries(s, d):
    """Documents as entries of their language's collection; those of even ids have a vector already."""
    doc = tb.table(s, d, "documents")
    return doc.select(F.col("lang").alias("collection"), F.col("doc_id").cast("string").alias("ref_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0))).alias("vector"), F.col("doc_id").alias("ord"))


@query("select lang as collection, count(*) as n from documents where doc_id % 2 <> 0 and text is not null group by lang")
def r10_queued_for_embedding(s, d):
    return vectors.embedding_requests(_entries(s, d))[1].select("collection", "n")


@query("""select lang as collection, case when arg_max(doc_id % 5 = 0, doc_id) then 'error' else 'ready' end as status, 0::bigint as pending from documents where doc_id % 2 <> 0 and text is not null group by lang
having count(*) filter (doc_id % 5 <> 0) > 0 or count(*) filter (doc_id % 5 = 0) > 0""")
def r11_status_after_answers(s, d):
    """Requests are queued, then answered, every fifth without a vector: a collection is ready, or in error if its last answer failed."""
    waiting, queued = vectors.embedding_requests(_entries(s, d))
    answers = waiting.withColumn("vector", F.when(F.col("ord") % 5 != 0, F.array(F.lit(1.0)))).withColumn("ord", F.col("ord") + 1_000_000_000)
    return vectors.indexing_status(queued.unionByName(vectors.answered(answers))).select("collection", "status", "pending")


@query("select lang as collection, count(*) as n, count(*) filter (doc_id % 3 <> 0) as embedded from documents where doc_id % 2 <> 0 and text is not null group by lang")
def r12_answered_requests(s, d):
    """Each text comes back beside its vector; a call that fails, here on every third text, costs its own rows."""
    waiting = vectors.embedding_requests(_entries(s, d))[0].withColumn("text", F.when(F.col("ord") % 3 == 0, "fail").otherwise("some words"))
    hashed = embed.hashed_words(8)

    def provider(texts):
        if "fail" in texts:
            raise RuntimeError("no vectors")
        return hashed(texts)

    answers = waiting.withColumn("vector", embed.embedded("text", provider, 1))
    return vectors.answered(answers).groupBy("collection").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "done", F.col("n"))), F.lit(0)).alias("embedded"))
