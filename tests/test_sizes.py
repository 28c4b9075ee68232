"""What keeps plans, tasks and workers small when the tables grow, and rows that only larger tables have."""

from pyspark.sql import functions as F


def test_even_joins_send_nothing_through_the_driver(spark):
    from basalt.llm.common import cut, joined_evenly

    rows = cut(spark.range(3000).selectExpr("id as row", "if(id % 3 = 0, 0, id) as k"))
    groups = cut(rows.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("size")))
    same = F.col("k") == F.col("of")
    for most in (1000, 1):  # with a large group, and without
        got = joined_evenly(rows, groups, F.col("k"), F.col("of"), same, "size", "row", most)
        assert "broadcast" not in got._jdf.queryExecution().analyzed().toString().lower()
        assert sorted(got.collect()) == sorted(rows.join(groups, same).collect())


def test_new_names_of_many_requests_of_one_role(spark):
    from basalt.operators import registry

    n = 3 * registry.CHUNK
    asked = spark.range(n).selectExpr("'r' as role", "id as ord")
    taken = spark.range(0, 2 * n, 2).selectExpr("'r' as role", "concat('@r', 100 + id) as name")
    names = registry.new_names(asked, taken)
    assert "row_number" not in names._jdf.queryExecution().analyzed().toString()  # no role in one task
    got = {r["ord"]: r["name"] for r in names.collect()}
    assert got == {i: f"@r{101 + 2 * i}" for i in range(n)}


def test_no_literal_list_of_taken_names_grows_with_the_table(spark, sf_dir):
    from basalt.plans import more

    assert len(more.a13_new_names(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_words_that_cancel_out_still_have_a_length(spark):
    import numpy as np

    from basalt.sources.embed import hashed_words

    embed = hashed_words(64)
    words = [f"w{i}" for i in range(400)]
    found = [(a, b) for a in words[:60] for b in words if np.allclose(np.add(embed([a])[0], embed([b])[0]), 0)]
    assert found
    assert all(abs(np.linalg.norm(embed([f"{a} {b}"])[0]) - 1) < 1e-9 for a, b in found)
    assert not any(embed([" "])[0])


def test_pages_that_share_an_address_are_crawled_apart(spark, tmp_path):
    from oracle import same

    import duckdb

    from basalt.plans import catalog

    rows = [(i, f"http://h/{i % 37}" + ("#x" if i % 11 == 3 else ""), f"<p>{i}</p>") for i in range(1, 120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(catalog.s26_crawl(spark, str(tmp_path)), con, catalog.oracle_sql()["s26_crawl"])


def test_levels_send_no_side_of_a_join_through_the_driver(spark, monkeypatch):
    from basalt.operators import dependencies

    plans, cut = [], dependencies.cut
    monkeypatch.setattr(dependencies, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    nodes = spark.range(20).selectExpr("concat('n', id) as name", "id as ord")
    needs = spark.range(1, 20).selectExpr("concat('n', id) as name", "concat('n', id div 2) as needs")
    levels = {r["name"]: (r["level"], r["place"]) for r in dependencies.levels(nodes, needs).collect()}
    assert levels["n0"] == (0, 1) and levels["n19"] == (5, 20)
    # Only numbering sends a list, of one row for each range.
    assert sum("Join" in p for p in plans) and not any("BroadcastHashJoin [name" in p or "BroadcastHashJoin [needs" in p for p in plans)


def test_scores_of_a_group_are_held_in_part_and_ties_stay(spark):
    import numpy as np

    from basalt.operators import vectors

    scores = np.array([[1.0, 3.0, 3.0, np.nan, 2.0, 3.0], [np.nan] * 6, [0.0] * 6])
    assert [p.tolist() for p in vectors._best(scores, 2)] == [[1, 2], [0, 1], [0, 1]]
    assert [p.tolist() for p in vectors._best(scores, 6)][0] == [1, 2, 5, 4, 0, 3]
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "ref_id long, vector array<double>")
    asked = v.filter("ref_id % 6 = 0").withColumnRenamed("ref_id", "query_id")
    want = sorted(vectors.search_all(v, asked, 7).collect())
    assert sorted(vectors.search_all(v, asked, 7, at_once=130).collect()) == want  # two queries at a time


def test_edits_of_long_files_read_each_text_once(spark):
    import time

    from basalt.operators import edits

    content = "\n".join(f"  line  number {i}" for i in range(3000))
    old = {"t": "line  number 2990 \nline  number 2991", "s": "  line number   2990", "f": "\n".join(f"  line  number {i}" if i != 104 else "other" for i in range(100, 110)), "n": "nothing like it"}
    f = spark.createDataFrame([("p", content)], "path string, content string")
    asked = spark.createDataFrame([(k, "p", v, "x") for k, v in old.items()], "edit_id string, path string, old string, new string")
    began = time.time()
    got = {r["edit_id"]: (r["start"], r["strategy"]) for r in edits.located(asked, f).collect()}
    place = lambda i: len("\n".join(content.split("\n")[:i])) + 2
    assert got == {"t": (place(2990), "line_trimmed"), "s": (place(2990), "whitespace_normalised"), "f": (place(100), "fuzzy"), "n": (None, None)}
    assert time.time() - began < 20  # by lines times lines it took minutes


def test_patterns_meet_files_by_name_and_folder(spark):
    import re

    from basalt.functions.text import glob_regex
    from basalt.sources import files

    paths = [f"{a}/{b}/{n}" for a in ("pics", "Docs") for b in ("1", "22") for n in ("0.PNG", "1.jpg", "x.pdf", "y.txt", "README")] + ["top.png", "/rooted.gif", "a//b.png"]
    patterns = ["pics/1/*", "pics/**", "**/0.png", "docs/22/?.jpg", "*.png", "**", "pics/*/x.pdf", "p*/1/0.PNG", "PICS/1/0.png", "a//*", "/r*", "none/*.jpg", "top.png"]
    prompts = spark.createDataFrame([(i, f"!!{p}") for i, p in enumerate(patterns)], "prompt_id int, text string")
    there = spark.createDataFrame([(p,) for p in paths], "path string")
    shown = files.media_references(prompts, there)
    assert "below " in shown._jdf.queryExecution().analyzed().toString()  # not by the suffix alone, which most files share
    got = {i: sorted(r["path"] for r in shown.collect() if r["prompt_id"] == i and r["kind"] in ("image", "document")) for i in range(len(patterns))}
    for i, p in enumerate(patterns):
        hit = [x for x in paths if re.search(glob_regex(p), x)]
        images = [x for x in hit if x.lower().endswith((".png", ".jpg", ".gif"))]
        assert got[i] == sorted(images or [x for x in hit if x.endswith(".pdf")]), p


def test_what_is_around_hits_is_read_from_one_stored_graph(spark, sf_dir):
    from basalt.plans import wider

    assert "lineitem" not in str(wider.t06_around_vector_hits(spark, sf_dir).inputFiles())


def test_links_of_fingerprints_are_not_sent_through_the_driver(spark):
    from basalt.llm.simhash import linked

    fps = spark.createDataFrame([(x,) for x in range(64)], "fp long")
    found = linked(fps)
    assert len(found.collect()) == sum(bin(a ^ b).count("1") <= 3 for a in range(64) for b in range(a + 1, 64))
    plan = found._jdf.queryExecution().executedPlan().toString()  # as it was run, after what Spark chose on the way
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_taken_names_are_not_sent_through_the_driver(spark, monkeypatch):
    from basalt.functions import numbering
    from basalt.operators import registry

    plans, cut = [], numbering.cut
    monkeypatch.setattr(numbering, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    asked = spark.range(30).selectExpr("'r' as role", "id as ord")
    taken = spark.range(0, 60, 2).selectExpr("id", "explode(sequence(0, 24)) as r").selectExpr("if(r = 0, 'r', 'r' || r) as role", "'@' || if(r = 0, 'r', 'r' || r) || (100 + id) as name")
    names = registry.new_names(asked, taken)
    assert {r["ord"]: r["name"] for r in names.collect()} == {i: f"@r{101 + 2 * i}" for i in range(30)}
    assert [("SortMergeJoin [name" in p, "BroadcastHashJoin [name" in p) for p in plans if "LeftAnti" in p] == [(True, False)]
    assert "SortMergeJoin [role" in names._jdf.queryExecution().executedPlan().toString()


def test_files_without_a_line_are_not_patched(spark, tmp_path):
    from oracle import same

    import duckdb

    from basalt.plans import catalog

    rows = [(i, x, "en", "web", len(x or "")) for i, x in enumerate(["", None, "a\nb", "\n", "\n\n", "a\n\n\n", "%s 100%d", "@@ -1 +1 @@"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(catalog.m17_patch(spark, str(tmp_path)), con, catalog.oracle_sql()["m17_patch"])


def test_more_walks_than_the_limit_of_a_recursion(spark, sf_dir):
    from oracle import same

    import duckdb

    from basalt.plans import catalog

    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    key, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(key, 5)
    try:
        same(catalog.queries()["d01_reached"](spark, sf_dir), con, catalog.oracle_sql()["d01_reached"])
        assert spark.conf.get(key) == "5"
    finally:
        spark.conf.set(key, before)
