"""Further queries, each with its SQL: parts of larger operators on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as tx
from basalt.operators import activity, edits, graph, mutate, ranking, registry, snapshots, timers, vectors
from basalt.plans import tables as tb
from basalt.plans.catalog import HITS_SQL, NOW, NOW_SQL, TIMER_SQL, _collections, _hits, query
from basalt.sources import files


@query("select c_name as name, c_mktsegment as role, c_custkey = 5 as is_self from customer where c_custkey % 10 <> 0")
def f08_roster(s, d):
    c = tb.table(s, d, "customer")
    me = c.filter("c_custkey = 5").first()["c_name"]
    members = c.select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("#"), "c_name")).otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("role"))
    return registry.roster(members, me)


@query("select c_name as role, c_name || ': customer (Skills: ' || case when c_custkey % 2 = 0 then 'a, b' else 'none' end || ')' as line from customer")
def f09_roles(s, d):
    n = tb.table(s, d, "customer")
    skill = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return registry.roles(n.select(F.col("c_name").alias("role"), F.lit("customer").alias("description"), skill.alias("skills")))


@query(f"with {tb.LOG_SQL} select ord, agent_id = '5' or name like '#%' or is_user_proxy as excluded from log")
def f10_excluded(s, d):
    return tb.activity_log(s, d).select("ord", activity.excluded("5").alias("excluded"))


@query("select p_name || ' ' || p_partkey as name, p_name || ' ' || p_partkey || ' — ' || p_type as line from part")
def f24_menu(s, d):
    p = tb.table(s, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("description"))
    return registry.menu(p)


@query("select c_name as name, c_nationkey as region from customer where c_custkey < 3")
def f23_lookup(s, d):
    n = tb.table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("region"))
    return registry.lookup(n, n.filter("c_custkey < 3").select("name"))[0].select("name", "region")


@query("select p_brand as name, count(*) as n from part group by p_brand having count(*) > 1")
def a10_duplicates(s, d):
    return registry.duplicates(tb.table(s, d, "part"), "p_brand")


@query("select 'k' || c_custkey % 1000 as ref_id, row_number() over (order by not bool_or(c_custkey % 3 = 0), coalesce(min(c_custkey) filter (c_custkey % 3 = 0), min(c_custkey))) as ord from customer group by 1")
def a11_merged(s, d):
    """Two lists that hold all customers between them, with keys that come again in either and in both."""
    c = tb.table(s, d, "customer").select(F.concat(F.lit("k"), (F.col("c_custkey") % 1000).cast("string")).alias("ref_id"), F.col("c_custkey").alias("ord"))
    return registry.merged(c.filter("ord % 3 = 0"), c.filter("ord % 3 <> 0")).select("ref_id", F.col("ord").cast("long").alias("ord"))


@query("select 'r' || c_nationkey as role, c_custkey as ord, '@r' || c_nationkey || (100 + 2 * row_number() over (partition by c_nationkey order by c_custkey) - 1) as name from customer where c_custkey % 2 = 0")
def a13_new_names(s, d):
    n = tb.table(s, d, "customer")
    role = F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("role")
    # Rows of a range: a sequence of literals would be made in the driver, as one array of the plan.
    taken = s.range(100, 101 + 2 * n.count(), 2).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("r"))
    taken = taken.select(F.format_string("r%d", "r").alias("role"), F.format_string("@r%d%d", "r", "k").alias("name"))
    return registry.new_names(n.filter("c_custkey % 2 = 0").select(role, F.col("c_custkey").alias("ord")), taken).select("role", "ord", "name")


@query(f"with {HITS_SQL} select ref_id, rank from hits where rank <= 7")
def t02_collection_search(s, d):
    rows, _ = _collections(s, d)
    own = rows.select(F.col("ref_id").cast("long").alias("ref_id"), "vector", F.col("ref_id").cast("long").alias("ord"))
    return ranking.resolve(vectors.search(own, tb.query_vector(s, d), 7), own.select("ref_id")).select("ref_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {HITS_SQL}, {tb.BOARD_SQL} select id, round(case when v.ref_id is null then 1.0::double else score end, 6) as score from tasks left join (from hits where rank <= 20 and score >= 0.1) v on v.ref_id = id
where status = 'O' and (v.ref_id is not null or contains(lower(description), '1-urg'))""".replace("case when v.ref_id is null then 1.0::double else score end", "case when v.ref_id is null then 1.0::double when contains(lower(description), '1-urg') then greatest(1.0, score) else score end"))
def t07_board_search(s, d):
    found = ranking.hybrid_board(tb.board(s, d), "1-URG", _hits(s, d, 20), 20, 0.1)
    return ranking.filtered(found, status="O").select("id", F.round("score", 6).alias("score"))


@query(f"with {tb.BOARD_SQL} select id, 'keyword' as found_by from tasks where contains(lower(description), 'medium')")
def t08_keyword_only(s, d):
    return ranking.hybrid_board(tb.board(s, d), "Medium", None, 20, 0.5).select("id", "found_by")


@query(f"with {tb.GRAPH_SQL} select u.a, u.b from u join e on e.name = u.b where u.a = 'N:4'")
def g04_incident_edges(s, d):
    e, r = tb.graph(s, d)
    return graph.both_ways(r).filter("a = 'N:4'").join(e.select(F.col("name").alias("b")), "b", "left_semi").select("a", "b")


@query("select 'C:' || (c_custkey + 5) as name from customer where 'C:' || (c_custkey + 5) not in (select 'C:' || c_custkey from customer)")
def m02_insert_if_absent(s, d):
    e, _ = tb.graph(s, d)
    c = tb.table(s, d, "customer")
    asked = c.select(F.concat(F.lit("C:"), (F.col("c_custkey") + 5).cast("string")).alias("name"), F.lit("customer").alias("entity_type"), F.lit("d").alias("description"), F.lit(None).cast("array<string>").alias("observations"), F.lit(False).alias("is_root"), F.col("c_custkey").alias("ord"))
    return mutate.create_entities(e, asked)[0].select("name")


@query("select 'C:' || c_custkey as name, case when c_custkey % 6 = 0 then 'a' when c_custkey % 3 = 0 then 'a,b' else '' end as observations from customer")
def m04_partial_update(s, d):
    e, _ = tb.graph(s, d)
    c = tb.table(s, d, "customer").filter("c_custkey % 3 = 0")
    name, none = F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("name"), F.lit(None).cast("string")
    fields = (none.alias("description"), none.alias("entity_type"), F.lit(None).cast("boolean").alias("is_root"))
    first = c.select(name, *fields, F.array(F.lit("a"), F.lit("b")).alias("add_observations"), F.lit(None).cast("array<string>").alias("remove_observations"), F.col("c_custkey").alias("ord"))
    second = c.filter("c_custkey % 6 = 0").select(name, *fields, F.lit(None).cast("array<string>").alias("add_observations"), F.array(F.lit("b")).alias("remove_observations"), (F.col("c_custkey") + 10_000_000).alias("ord"))
    after = mutate.update_entities(e, first.unionByName(second))[0]
    return after.filter("entity_type = 'customer'").select("name", F.array_join("observations", ",").alias("observations"))


@query(f"with {tb.GRAPH_SQL} select name || ': ' || description as text from e")
def m08_embedding_text(s, d):
    return mutate.embedding_text(*tb.graph(s, d)).select("text")


@query("select o_orderkey as notification_id from orders union all select (select max(o_orderkey) from orders) + row_number() over (order by c_custkey) from customer")
def w03_sequential_ids(s, d):
    t, c = tb.timers(s, d), tb.table(s, d, "customer")
    asked = c.select(F.col("c_custkey").cast("string").alias("owner_id"), F.col("c_name").alias("owner_name"), F.lit("x").alias("content"), F.expr("timestamp_ntz '1996-01-01 00:00:00'").alias("created_at"), F.lit(60).alias("delay"), F.col("c_custkey").alias("ord"))
    return timers.schedule(t, asked).select("notification_id")


@query(f"with {TIMER_SQL} select id as notification_id from t, now where fire_at > now or (owner not in (select 'C' || c_custkey from customer where c_acctbal > 0) and epoch(now) - epoch(fire_at) < 86400)")
def r03_remaining(s, d):
    now = F.expr("timestamp_ntz '1996-01-01 12:00:00'")
    return timers.remaining(timers.decide(tb.timers(s, d), tb.roster(s, d), now, 86400)).select("notification_id")


@query(f"with {tb.LOG_SQL} select count(*) as n from log where kind = 'received' and agent_id <> '5' and name not like '#%' and not is_user_proxy and ts >= {NOW_SQL} - interval 1 hour and message_id not in (select message_id from log where kind = 'processed')")
def r04_stale(s, d):
    return activity.open_events(tb.activity_log(s, d), "5", F.expr(NOW), 3600).agg(F.count("*").alias("n"))


@query("select doc_id, replace(text, chr(10), chr(13) || chr(10)) as text from documents")
def x07_endings(s, d):
    return tb.table(s, d, "documents").select("doc_id", tx.with_endings("text", "\r\n").alias("text"))


@query("select c_custkey, case when c_custkey > 12 then '+' else '' end || (c_custkey - 12) as moved from customer")
def x42_signed(s, d):
    return tb.table(s, d, "customer").select("c_custkey", snapshots.signed(F.col("c_custkey") - 12).alias("moved"))


TYPED = ("lineitem", "orders", "events", "documents", "embeddings")


@query(" union all ".join(f"""select '{t}' as of, column_name as name, case when column_type like '%[]' then 'array' when column_type in ('BIGINT', 'INTEGER') then 'integer' when column_type in ('DOUBLE', 'FLOAT') then 'number' when column_type = 'BOOLEAN' then 'boolean' else 'string' end as type
from (describe select * from {t})""" for t in TYPED))
def x14_type_names(s, d):
    """Of the columns of five tables."""
    rows = s.createDataFrame([(t, c, kind) for t in TYPED for c, kind in tb.table(s, d, t).dtypes], "of string, name string, kind string")
    return rows.select("of", "name", registry.type_name("kind").alias("type"))


@query(f"with {tb.FILES_SQL} select path from files where mtime % 4 <> 0 union all select 'new/' || mtime from files where mtime % 10 = 0")
def s15_write_files(s, d):
    f = tb.files(s, d)
    new = f.filter("unix_timestamp(mtime) % 10 = 0").select(F.format_string("new/%d", F.unix_timestamp("mtime")).alias("path"), F.lit("x\n").alias("content"), "mtime")
    return files.write_files(files.delete_files(f, f.filter("unix_timestamp(mtime) % 4 = 0").select("path"))[0], new).select("path")


@query("select 'missing/' || n_nationkey as path from nation")
def s16_missing_files(s, d):
    asked = tb.table(s, d, "nation").select(F.format_string("missing/%d", "n_nationkey").alias("path"))
    return files.delete_files(tb.files(s, d), asked)[1]


@query(f"with {tb.FILES_SQL} select path, replace(path, '.txt', '') as clean from files")
def s19_paths(s, d):
    f = tb.files(s, d)
    messy = F.concat(F.lit("./x/.././"), F.replace("path", F.lit(".txt"), F.lit("")))
    return f.select("path", files.normal_path(messy).alias("clean"))


@query(f"with {tb.FILES_SQL} select count(*) + 1 as n from files")
def s22_seed_files(s, d):
    f = tb.files(s, d)
    seeds = f.limit(3).unionByName(f.limit(1).withColumn("path", F.lit("seed")))
    return files.seed_files(f, seeds).agg(F.count("*").alias("n"))


@query("select r_regionkey, r_name as content from region")
def s23_resource_bytes(s, d):
    r = tb.table(s, d, "region")
    kind = F.when(F.col("r_regionkey") % 2 == 0, "image").otherwise("text")
    content = F.when(F.col("r_regionkey") % 2 == 0, F.base64(F.encode("r_name", "UTF-8"))).otherwise(F.col("r_name"))
    return r.select("r_regionkey", F.decode(files.resource_bytes(kind, content), "UTF-8").alias("content"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'image/png' when 1 then 'image/jpeg' end as type from part")
def s32_media_types(s, d):
    p = tb.table(s, d, "part")
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".PNG").when(F.col("p_partkey") % 3 == 1, ".jpg").otherwise(".txt")
    return p.select("p_partkey", files.media_type(F.concat(F.lit("a/b"), suffix)).alias("type"))


@query(f"with {tb.FILES_SQL} select path, split_part(content, chr(10), 1) = 'none' as x, 'exact' as strategy from files where contains(content, ' and ')")
def x18_exact_place(s, d):
    f = tb.files(s, d)
    edit = f.select(F.col("path").alias("edit_id"), "path", F.lit(" and ").alias("old"), F.lit("").alias("new")).filter("true")
    found = edits.located(edit.join(f.filter(F.contains("content", F.lit(" and "))).select("path"), "path", "left_semi"), f)
    return found.select("path", (F.split("content", "\n")[0] == "none").alias("x"), "strategy")


@query("select 'new' || c_nationkey as key, 'exists' as reason, count(*) - 1 as n from customer group by c_nationkey having count(*) > 1")
def w07_second_of_a_name(s, d):
    """One batch creates an entity for each customer's nation: the first of a name is made, the others are errors."""
    c = tb.table(s, d, "customer")
    asked = c.select(F.concat(F.lit("new"), F.col("c_nationkey").cast("string")).alias("name"), F.lit("nation").alias("entity_type"), F.lit("").alias("description"), F.lit(None).cast("array<string>").alias("observations"), F.lit(False).alias("is_root"), F.col("c_custkey").alias("ord"))
    return mutate.create_entities(tb.graph(s, d)[0], asked)[1].groupBy("key", "reason").agg(F.count("*").alias("n"))


@query(r"""select c_custkey, concat_ws(chr(10), '--- a/p', '+++ b/p', '@@ -1,3 +1,3 @@', ' a', '-b', '+' || c_name, ' c') as diff from customer""")
def x15_unified_diff(s, d):
    t = tb.table(s, d, "customer")
    return t.select("c_custkey", edits.diff(F.lit("a\nb\nc\n"), F.concat(F.lit("a\n"), "c_name", F.lit("\nc\n")), F.lit("p")).alias("diff"))
