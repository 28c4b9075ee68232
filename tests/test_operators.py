"""Fixed cases of operators whose order or text matters."""

import datetime
import difflib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.functions import numbering
from basalt.functions import text as tx
from basalt.operators import activity, cache, dependencies, edits, graph, mailbox, mutate, ranking, search, snapshots, timers, vectors
from basalt.sources import embed, files, pages


def col(df, name):
    return [r[name] for r in df.collect()]


def test_cosine_order_zero_vector_and_ties(spark):
    v = spark.createDataFrame([("far", [0.0, 1.0, 0.0], 0), ("close", [1.0, 0.0, 0.0], 1), ("mid", [0.7, 0.7, 0.0], 2), ("zero", [0.0, 0.0, 0.0], 3), ("twin", [2.0, 0.0, 0.0], 4), ("short", [1.0], 5), ("none", None, 6)], "ref_id string, vector array<double>, ord int")
    top = vectors.search(v, [1.0, 0.0, 0.0], 10).orderBy("rank").collect()
    assert [r["ref_id"] for r in top] == ["close", "twin", "mid", "far", "zero"]
    assert top[-1]["score"] == 0.0


def test_hybrid_graph_ranks_a_double_hit_first(spark):
    v = spark.createDataFrame([("bob", 0.9, 1), ("alice", 0.8, 2)], "ref_id string, score double, rank int")
    w = spark.createDataFrame([("entity", "alice", 0, 1.0), ("entity", "carol", 1, 1.0)], "kind string, ref_id string, ord int, score double")
    got = ranking.hybrid_graph(v, w, 10).orderBy("place").collect()
    assert [(r["ref_id"], round(r["score"], 3)) for r in got] == [("alice", 1.3), ("carol", 1.0), ("bob", 0.9)]
    assert col(ranking.hybrid_graph(v.limit(0), w, 1, 5.0), "ref_id") == ["alice"]


def test_collections_upsert_save_and_load(spark, tmp_path):
    registry = vectors.create_collection(spark.createDataFrame([], "name string, dimension int, backend string, tenant string, status string"), "a", 2)
    assert vectors.create_collection(registry, "a", 3).count() == 1
    entries = spark.createDataFrame([("a", "x", "one", [1.0, 0.0]), ("a", "x", "two", [0.0, 1.0]), ("a", "y", "bad", [1.0]), ("b", "z", "lost", [1.0, 2.0])], "collection string, ref_id string, text string, vector array<double>").coalesce(1)
    kept, refused = vectors.add(spark.createDataFrame([], vectors.SCHEMA), entries, registry)
    assert col(kept, "text") == ["two"]
    assert sorted(col(refused, "reason")) == ["unknown collection", "wrong dimension"]
    vectors.save(kept, str(tmp_path / "v"))
    assert vectors.load(spark, str(tmp_path / "v"), "a").count() == 1
    assert vectors.load(spark, str(tmp_path / "nothing")).count() == 0


GRAPH = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")]


def small_graph(spark):
    names = sorted({n for e in GRAPH for n in e})
    e = spark.createDataFrame([(n, n, "t", "", [], n == "a", i) for i, n in enumerate(names)], "ref_id string, name string, entity_type string, description string, observations array<string>, is_root boolean, ord long")
    r = spark.createDataFrame([(f"{a}{b}", a, b, "to", "", i) for i, (a, b) in enumerate(GRAPH)], "ref_id string, from_entity string, to_entity string, relation_type string, description string, ord long")
    return e, r


def test_shortest_path_and_the_order_of_ties(spark):
    e, r = small_graph(spark)
    pairs = spark.createDataFrame([(1, "a", "d"), (2, "a", "y"), (3, "a", "a"), (4, "a", "nobody")], "pair_id int, source string, target string")
    got = {x["pair_id"]: (x["nodes"], x["edges"]) for x in graph.shortest_paths(e, r, pairs).collect()}
    assert got == {1: (["a", "c", "d"], ["ac", "cd"]), 3: (["a"], [])}


def test_waypoints_block_the_way_back(spark):
    e, r = small_graph(spark)
    nodes, edges = graph.waypoints(e, r, "a", [("to", "b"), ("to", "c")], 1)
    assert sorted(col(nodes, "name")) == ["a", "b", "c", "d"]
    assert sorted(col(edges, "ref_id")) == ["ab", "ac", "bc", "cd"]
    nodes, edges = graph.waypoints(e, r, "a", [("to", "d")])
    assert nodes.count() == 0 and edges.count() == 0


def test_batch_collects_errors_and_applies_the_rest(spark):
    e, r = small_graph(spark)
    batch = mutate.GraphBatch(
        spark.createDataFrame([("n", "t", "d", ["o"], False, 0), ("n", "t", "d", None, False, 1), ("a", "t", "d", None, False, 2)], "name string, entity_type string, description string, observations array<string>, is_root boolean, ord int"),
        spark.createDataFrame([("n", "a", "to", "", 0), ("n", "a", "to", "", 1), ("ghost", "none", "to", "", 2)], "from_entity string, to_entity string, relation_type string, description string, ord int"),
        spark.createDataFrame([("n", None, None, None, ["p", "o"], None, 0), ("n", "e", None, None, None, ["o"], 1), ("b", "", None, None, None, ["none"], 2)], "name string, description string, entity_type string, is_root boolean, add_observations array<string>, remove_observations array<string>, ord int"),
        spark.createDataFrame([("a", "b", "to", 0), ("a", "b", "from", 1)], "from_entity string, to_entity string, relation_type string, ord int"),
        spark.createDataFrame([("c", 0), ("nobody", 1)], "name string, ord int"),
    )
    change = mutate.update_graph(e, r, batch)
    new = change.entities.filter("name = 'n'").first()
    assert new["observations"] == ["p"] and new["description"] == "e"
    assert sorted(col(change.relations, "ref_id")) == sorted(["xy", change.relations.filter("from_entity = 'n'").first()["ref_id"]])
    assert sorted((x["step"], x["key"], x["reason"]) for x in change.errors.collect()) == [
        ("create_entities", "a", "exists"), ("create_entities", "n", "exists"), ("create_relations", "ghost", "no from_entity"),
        ("delete_entities", "nobody", "not found"), ("delete_relations", "a b from", "not found"),
    ]
    assert sorted((x["op"], x["kind"]) for x in change.delta.collect()) == sorted([("added", "entity"), ("added", "relation"), ("modified", "entity")] + [("removed", "relation")] * 4 + [("removed", "entity")])


def test_timers_at_their_limits(spark):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, "a", at), (2, "a", at + datetime.timedelta(seconds=1)), (3, "z", at), (4, "z", at - datetime.timedelta(seconds=300))]
    t = spark.createDataFrame(rows, "notification_id int, owner_name string, fire_at timestamp_ntz")
    now = F.expr("timestamp_ntz '2024-01-01 12:00:00'")
    got = {r["notification_id"]: r["decision"] for r in timers.decide(t, spark.createDataFrame([("a",)], "name string"), now).collect()}
    assert got == {1: "delivered", 2: "waiting", 3: "postponed", 4: "dropped"}
    assert sorted(col(timers.remaining(timers.decide(t, None, now)), "notification_id")) == [2]


def test_single_flight_and_failures_that_are_remembered(spark):
    ev = [("k", "request", None, 0.0, 0), ("k", "request", None, 1.0, 1), ("k", "fail", None, 2.0, 2), ("k", "request", None, 30.0, 3), ("k", "request", None, 70.0, 4), ("k", "deliver", "v", 71.0, 5), ("k", "request", None, 99.0, 6)]
    events = spark.createDataFrame(ev, "key string, event string, value string, t double, ord int")
    assert sorted(col(cache.started(events.filter("ord <> 3")), "ord")) == [0, 4]
    assert cache.contents(events, 100.0).first()["value"] == "v"


def test_mailbox_stop_word(spark):
    rows = spark.createDataFrame([("/stop",), ("  /stop now",), ("/stopwatch",), ("please /stop",), (None,)], "content string").withColumn("kind", F.lit("message"))
    assert col(rows.select(mailbox.cancels().alias("c")), "c") == [True, True, False, False, False]


def test_order_of_dependencies(spark):
    n = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "name string, ord int")
    d = spark.createDataFrame([("a", "c")], "name string, needs string")
    assert col(dependencies.levels(n, d).orderBy("place"), "name") == ["b", "c", "a"]
    with pytest.raises(ValueError):
        dependencies.levels(n, spark.createDataFrame([("a", "b"), ("b", "a")], "name string, needs string"))


def test_lines_and_endings(spark):
    rows = spark.createDataFrame([("a\r\nb\n",), ("",), (None,), ("x y\x85z",), ("\n",)], "t string")
    assert col(rows.select(tx.lines("t").alias("l")), "l") == [["a", "b"], [], [], ["x", "y", "z"], [""]]
    ends = spark.createDataFrame([("a\r\nb\r\nc\n",), ("a\r\nb\n",), ("",)], "t string")
    assert col(ends.select(tx.line_ending("t").alias("e")), "e") == ["\r\n", "\n", "\n"]


@pytest.mark.parametrize("pattern, path, found", [("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("**.py", "a/c.PY", True), ("*.{md,txt}", "r.txt", True), ("*.md", "d/r.md", False), ("a?c/x", "abc/x", True), ("a+", "aa", False)])
def test_globs(spark, pattern, path, found):
    assert spark.range(1).select(F.lit(path).rlike(tx.glob_regex(pattern)).alias("m")).first()["m"] is found


def test_paths_stay_in_the_root(spark):
    rows = spark.createDataFrame([("a/./b",), ("a/../b",), ("../b",), ("/etc",), ("a/../../b",)], "p string")
    assert col(rows.select(files.normal_path("p").alias("p")), "p") == ["a/b", "b", None, None, None]


def test_edits_find_by_each_way(spark):
    text = "def f():\n    x = 1\n    y  =  2\n    return x\nend one\nend two\nend three\n"
    f = spark.createDataFrame([("p", text)], "path string, content string")
    cases = {
        "exact": "x = 1", "line_trimmed": "  x = 1\n        y  =  2", "whitespace_normalised": "    y = 2", "dedented": "\tend one\n\tend two",
        "trimmed_boundary": "\n\nreturn x\n\n", "escape_normalised": "end one\\nend two",
    }
    e = spark.createDataFrame([(k, "p", v, "NEW", i) for i, (k, v) in enumerate(cases.items())], "edit_id string, path string, old string, new string, ord int")
    got = {r["edit_id"]: r["strategy"] for r in edits.located(e, f).collect()}
    assert got["exact"] == "exact" and got["line_trimmed"] == "line_trimmed" and got["whitespace_normalised"] == "whitespace_normalised"
    assert got["escape_normalised"] == "escape_normalised" and got["dedented"] in ("dedented", "line_trimmed") and got["trimmed_boundary"] in ("trimmed_boundary", "line_trimmed")
    after = edits.edited(e.filter("edit_id = 'line_trimmed'"), f).first()["content"]
    assert after.startswith("def f():\nNEW") and after.endswith("end three\n")


def test_most_alike_window_is_that_of_all_windows(spark):
    draw = random.Random(3)
    cases = []
    for i in range(60):
        wanted = [draw.choice("abc") for _ in range(draw.randint(0, 7))]
        lines = [draw.choice("abcd") for _ in range(draw.randint(0, 12))]
        if i % 2:
            lines += wanted[:-1] + ["x"] + wanted + lines
        cases.append((i, lines, wanted))
    expected = {}
    for i, lines, wanted in cases:
        likes = [(difflib.SequenceMatcher(None, lines[a : a + len(wanted)], wanted, autojunk=False).ratio(), -a - 1) for a in range(len(lines) - len(wanted) + 1) if wanted]
        if likes and max(likes)[0] >= edits.ALIKE:
            expected[i] = -max(likes)[1]
    got = edits.most_alike(spark.createDataFrame(cases, "edit_id int, l array<string>, w array<string>")).collect()
    assert {r["edit_id"]: r["line"] for r in got} == expected and len(expected) > 20


def test_fuzzy_edit(spark):
    ten = [f"line {i}" for i in range(10)]
    f = spark.createDataFrame([("p", "\n".join(["top", *ten, "end"]) + "\n")], "path string, content string")
    e = spark.createDataFrame([("e", "p", "\n".join([*ten[:9], "other"]), "X", 0)], "edit_id string, path string, old string, new string, ord int")
    assert edits.located(e, f).first()["strategy"] == "fuzzy"


def test_edits_in_order_stop_at_a_failure(spark):
    f = spark.createDataFrame([("p", "a b c")], "path string, content string")
    e = spark.createDataFrame([("1", "p", "a", "x", 0), ("2", "p", "none", "y", 1), ("3", "p", "c", "z", 2)], "edit_id string, path string, old string, new string, ord int")
    assert tuple(edits.edited_in_order(e, f).first()) == ("p", "x b c", 1)


def test_patch_updates_creates_and_deletes(spark):
    f = spark.createDataFrame([("a", "1\n2\n3\n4\n", 8), ("gone", "x\n", 2), ("gone2", "x\n", 2)], "path string, content string, size long").withColumn("mtime", F.timestamp_seconds(F.lit(0)))
    text = "--- a/a\n+++ b/a\n@@ -1,2 +1,3 @@\n 1\n-2\n+two\n+2.5\n@@ -4 +5,2 @@\n 4\n+5\n--- /dev/null\n+++ b/new\n@@ -0,0 +1,2 @@\n+n1\n+n2\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n--- a/gone2\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    after, report = edits.patched(spark.createDataFrame([("p", text)], "patch_id string, text string"), f)
    assert {r["path"]: r["content"] for r in after.collect()} == {"a": "1\ntwo\n2.5\n3\n4\n5\n", "new": "n1\nn2\n"}
    assert {r["path"]: r["done"] for r in report.collect()} == {"a": "updated", "new": "created", "gone": "deleted", "gone2": "deleted"}


def test_board_update_takes_the_first_of_an_id_and_deletes_all(spark):
    t = spark.createDataFrame([(1, "pending", "d", "o", "c", None, 0), (1, "pending", "d2", "o", "c", None, 1), (2, "pending", "d", "o", "c", None, 2)], "id long, status string, description string, owner string, creator string, output string, ord long")
    u = spark.createDataFrame([(1, "done", None, None, "x" * 151, 0), (9, "done", None, None, None, 1)], "id long, status string, description string, owner string, output string, ord long")
    after, errors = mutate.update_board(t, None, u, spark.createDataFrame([(2, 0)], "id long, ord long"))
    assert [(r["status"], len(r["output"] or "")) for r in after.orderBy("ord").collect()] == [("done", 150), ("pending", 0)]
    assert col(errors, "key") == ["9"]


def test_activity_suspects_and_placeholders(spark):
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([("received", "m1", "1", "ann", "r", False, at, None, 0), ("received", "m2", "1", "ann", "r", False, at + datetime.timedelta(seconds=7), None, 1), ("received", "m3", "2", "#tool", "r", False, at, None, 2), ("sent", "m1", "9", "bob", "r", False, at, "do it", 3)], "kind string, message_id string, agent_id string, name string, role string, is_user_proxy boolean, ts timestamp_ntz, text string, ord long")
    got = activity.busy(log, "9", F.expr("timestamp_ntz '2024-01-01 00:00:09'")).collect()
    assert [(r["name"], r["message_id"], r["suspect"], r["text"]) for r in got] == [("ann", "m1", True, "do it")]


def test_embedding_is_repeatable_and_failures_are_null(spark):
    rows = spark.createDataFrame([("a b",), ("b a",), (None,)], "t string")
    got = col(rows.select(embed.embedded("t", embed.hashed_words(8)).alias("v")), "v")
    assert got[0] == got[1] and got[2] is None

    def fails(texts):
        raise RuntimeError

    assert col(rows.select(embed.embedded("t", fails).alias("v")), "v") == [None] * 3


def test_page_text_and_crawl(spark):
    p = spark.createDataFrame([(1, "u1", "<html><head><title>x</title></head><body><p>One&nbsp;&amp; two</p><script>bad()</script><a class=k href='u2'>go</a> <a href=\"u3\">on</a></body>"), (2, "u2", "<a href=u1>back</a><a href=u4>x</a>"), (3, "u3", "three")], "page_id int, url string, html string")
    assert pages.extracted(p).orderBy("page_id").first()["text"] == "One & two go on"
    assert [(r["url"], r["level"]) for r in pages.crawl(p, "u1", 2).collect()] == [("u1", 0), ("u2", 1), ("u3", 1)]
    assert [r["url"] for r in pages.crawl(p, "u1", 2, breadth=1).collect()] == ["u1", "u2"]
    assert pages.crawl(p, "nowhere", None).count() == 0
    whole = spark.createDataFrame([("https://h.example/a/b?x#y", "<a href='/c'>.<a href=d>.<a href='//k.example/e'>.<a href='?z'>.<a href='mailto:x'>.<a href='http://m.example/'>"), ("https://h.example", "<a href=d>")], "url string, html string")
    got = sorted((r["url"], r["ord"], r["target"]) for r in pages.links(whole).collect())
    assert [t for _, _, t in got] == ["https://h.example/d", "https://h.example/c", "https://h.example/a/d", "https://k.example/e", "https://h.example/a/b?z", "mailto:x", "http://m.example/"]


def test_update_blocks_are_numbered(spark):
    sections = spark.createDataFrame([("a", "k", "new"), ("b", "k", "same"), ("c", "k", "first")], "provider string, kind string, state string")
    base = spark.createDataFrame([("a", "k", "old", 4), ("b", "k", "same", 2)], "provider string, kind string, state string, number long")
    assert {r["provider"]: (r["mode"], r["number"]) for r in snapshots.due_updates(sections, base).collect()} == {"a": ("delta", 5), "c": ("full", 1)}
    assert {r["provider"]: r["number"] for r in snapshots.advanced(sections, base).collect()} == {"a": 5, "b": 2, "c": 1}


def test_no_limit_is_no_number(spark):
    parts = spark.range(300).select(F.col("id").alias("ref_id"), F.lit("ring").alias("name"), F.lit("").alias("description"), F.lit("").alias("entity_type"), F.col("id").alias("ord"))
    assert ranking.keyword_hits(parts, None, "RING", None).count() == 300
    events = spark.range(300).select(F.col("id").cast("string").alias("key"), F.lit("deliver").alias("event"), F.lit("v").alias("value"), F.lit(0.0).alias("t"), F.col("id").alias("ord"))
    assert cache.contents(events, 0.0, None).count() == 300 and cache.contents(events, 0.0).count() == 128


@pytest.mark.parametrize("rows", [0, 1, 200])
def test_places_are_those_of_one_sorted_list(spark, rows):
    df = spark.range(rows).select((F.col("id") * 37 % 101).alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("owner"), "id").repartition(5)
    got = sorted(numbering.placed(df, F.desc("k"), "id").select("place", "k", "id").collect())
    want = sorted(((i * 37 % 101, i) for i in range(rows)), key=lambda x: (-x[0], x[1]))
    assert [tuple(r) for r in got] == [(n, *x) for n, x in enumerate(want, 1)]
    own = [tuple(r) for r in numbering.placed_within(df, ["owner"], "id").select("owner", "number", "id").collect()]
    hot = [i for i in range(rows) if i % 3 == 0]
    assert sorted(x for x in own if x[0] == "hot") == [("hot", n, i) for n, i in enumerate(hot, 1)]
    assert all(n == 1 for o, n, _ in own if o != "hot") and len(own) == rows


def test_paths_of_sixty_hops_and_chains_of_levels(spark):
    e = spark.range(62).select(F.col("id").cast("string").alias("name"))
    r = spark.range(60).select(F.format_string("e%d", "id").alias("ref_id"), F.col("id").cast("string").alias("from_entity"), (F.col("id") + 1).cast("string").alias("to_entity"), F.lit("next").alias("relation_type"), F.col("id").alias("ord"))
    pairs = spark.createDataFrame([(1, "0", "60"), (2, "5", "3"), (3, "0", "61"), (4, "7", "7")], "pair_id long, source string, target string")
    got = {x["pair_id"]: (len(x["edges"]), x["nodes"][0], x["nodes"][-1]) for x in graph.shortest_paths(e, r, pairs).collect()}
    assert got == {1: (60, "0", "60"), 2: (2, "5", "3"), 4: (0, "7", "7")}
    nodes = spark.range(30).select(F.col("id").cast("string").alias("name"), (-F.col("id")).alias("ord"))
    chain = spark.range(29).select((F.col("id") + 1).cast("string").alias("name"), F.col("id").cast("string").alias("needs"))
    assert {(x["name"], x["level"], x["place"]) for x in dependencies.levels(nodes, chain).collect()} == {(str(i), i, i + 1) for i in range(30)}
    with pytest.raises(ValueError):
        dependencies.levels(nodes, chain.unionByName(spark.createDataFrame([("0", "29")], "name string, needs string")))
    assert dependencies.levels(nodes.limit(0), chain.limit(0)).count() == 0


def test_a_second_patch_of_a_path_is_refused(spark):
    f = spark.createDataFrame([("a", "x\n", 2, datetime.datetime(2024, 1, 1))], "path string, content string, size long, mtime timestamp")
    text = "--- a/a\n+++ b/a\n@@ -1,1 +1,1 @@\n-x\n+%s\n"
    after, report = edits.patched(spark.createDataFrame([(1, text % "one"), (2, text % "two")], "patch_id int, text string"), f)
    assert col(after, "content") == ["one\n"]
    assert {(x["patch_id"], x["done"]) for x in report.collect()} == {(1, "updated"), (2, "refused")}


def test_batch_search_equals_single_ones_and_leaves_out_other_dimensions(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(90, [1.0]), (91, None)], "ref_id long, vector array<double>").withColumn("ord", F.col("ref_id"))
    asked = v.filter("ref_id % 9 = 0").select(F.col("ref_id").alias("query_id"), "vector")
    for block, shard in ((2, 7), (2048, 65536)):
        got = {}
        for x in vectors.search_all(v, asked, 3, block=block, shard=shard).collect():
            got.setdefault(x["query_id"], {})[x["rank"]] = x["ref_id"]
        for q in asked.filter("query_id < 90").collect():
            want = {x["rank"]: x["ref_id"] for x in vectors.search(v, q["vector"], 3).collect()}
            assert got[q["query_id"]] == want
        assert got[90] == {1: 90}
    assert vectors.search_all(v, asked.limit(0), 3).count() == 0


def test_entries_keep_the_last_by_their_order(spark):
    registry = vectors.create_collection(spark.createDataFrame([], "name string, dimension int, backend string, tenant string, status string"), "a", 1)
    entries = spark.createDataFrame([("a", str(i % 10), f"t{i}", [float(i)], i) for i in range(100)], "collection string, ref_id string, text string, vector array<double>, ord int").repartition(7)
    got = vectors.add(spark.createDataFrame([], vectors.SCHEMA), entries, registry)[0]
    assert sorted((r["ref_id"], r["text"]) for r in got.collect()) == [(str(i), f"t{90 + i}") for i in range(10)]


def test_modes_of_graph_search(spark):
    e = spark.createDataFrame([("i1", "Ann", "person", "builds", False, 0), ("i2", "Bob", "person", "sings", False, 1)], "ref_id string, name string, entity_type string, description string, is_root boolean, ord long")
    r = spark.createDataFrame([("r1", "Ann", "Bob", "BUILDS_WITH", "", 0)], "ref_id string, from_entity string, to_entity string, relation_type string, description string, ord long")
    hits = spark.createDataFrame([("i2", 0.9, 1), ("gone", 0.8, 2)], "ref_id string, score double, rank int")
    found = search.search_graph(e, r, "BUILD", neighbours=True, edges=True, paths=True)
    assert [(x["kind"], x["label"]) for x in found.hits.orderBy("place").collect()] == [("entity", "Ann"), ("relation", "Ann BUILDS_WITH Bob")]
    assert col(found.neighbours, "name") == ["Bob"] and col(found.edges, "ref_id") == ["r1"] and found.paths.count() == 0
    assert col(search.search_graph(e, r, "", "vector", 5, 0.5, hits).hits, "label") == ["Bob"]
    assert search.search_graph(e, r, "x", "vector").hits.count() == 0
    assert search.search_graph(e, r, "build", "hybrid").hits.count() == 2
    both = search.search_graph(e, r, "build", "hybrid", 5, 0.0, hits).hits.orderBy("place").collect()
    assert [x["label"] for x in both] == ["Ann", "Ann BUILDS_WITH Bob", "Bob"]
    with pytest.raises(ValueError):
        search.search_graph(e, r, "x", "other")


def test_changed_collections_are_written_alone(spark, tmp_path):
    path, schema = str(tmp_path / "v"), vectors.SCHEMA
    rows = spark.createDataFrame([(c, str(i), "t", [1.0], 1.0, i) for c in "ab" for i in range(3)], schema)
    vectors.save(rows, path)
    stored = vectors.load(spark, path)
    vectors.persist(stored.filter("collection <> 'a'"), path, ["a"])
    assert sorted(col(vectors.load(spark, path), "collection")) == ["b"] * 3
    assert vectors.restored(vectors.dumped(rows)).exceptAll(rows).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.sampled_from("abc/.{},* "), max_size=14))
def test_brace_patterns_as_rows_equal_those_of_one(spark, pattern):
    got = tx.expanded_rows(spark.createDataFrame([(1, pattern)], "pattern_id int, pattern string"))
    assert sorted(col(got, "pattern")) == sorted(tx.expanded(pattern))
