"""The registry of functions: names that are taken, needs, and calls from SQL."""

import pytest
from pyspark.sql import functions as F

from basalt.functions.registry import REGISTRY, Registry


@pytest.fixture(scope="module")
def sql(spark):
    REGISTRY.install(spark, replace=True)
    return spark.sql


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_name_is_taken_once():
    own = Registry()
    own.sql("twice", "(x INT) RETURNS INT", "x * 2")
    for name in ("twice", "TWICE"):
        with pytest.raises(ValueError, match="collision"):
            own.sql(name, "(x INT) RETURNS INT", "x")
        with pytest.raises(ValueError, match="collision"):
            own.table(name, "()")(object)
    with pytest.raises(ValueError, match="not a name"):
        own.sql("drop table", "() RETURNS INT", "1")
    assert list(own.functions) == ["twice"]


def test_names_of_the_session_are_refused_and_nothing_is_installed(spark):
    own = Registry()
    own.sql("fresh_name", "(x INT) RETURNS INT", "x")
    own.sql("upper", "(x STRING) RETURNS STRING", "x")
    for replace in (False, True):
        with pytest.raises(ValueError, match="upper"):
            own.install(spark, replace=replace)
    assert not spark.catalog.functionExists("fresh_name")
    own.install(spark, ["fresh_name"])
    with pytest.raises(ValueError, match="fresh_name"):
        own.install(spark, ["fresh_name"])
    assert own.install(spark, ["fresh_name"], replace=True) == ["fresh_name"]
    spark.sql("drop temporary function fresh_name")


def test_needs_come_first_and_are_checked(spark):
    own = Registry()
    own.sql("outer_one", "(x INT) RETURNS INT", "inner_one(x) + 1", ["inner_one"])
    with pytest.raises(ValueError, match="'inner_one' is not registered, and 'outer_one' needs it"):
        own.install(spark)
    own.sql("inner_one", "(x INT) RETURNS INT", "x * 10")
    assert own.install(spark, ["outer_one"]) == ["inner_one", "outer_one"]
    assert spark.sql("select outer_one(4) as y").first()["y"] == 41
    for name in ("outer_one", "inner_one"):
        spark.sql(f"drop temporary function {name}")
    own.sql("chicken", "() RETURNS INT", "egg()", ["egg"])
    own.sql("egg", "() RETURNS INT", "chicken()", ["chicken"])
    with pytest.raises(ValueError, match="need each other"):
        own.needed(["egg"])


def test_python_functions_are_called_from_sql(spark):
    own = Registry()

    @own.scalar("backwards", "(t STRING) RETURNS STRING")
    @F.udf("string")
    def backwards(t):
        """The text from its end."""
        return t and t[::-1]

    own.install(spark)
    assert rows(spark.sql("select backwards(t) from values ('abc'), (null), ('') v(t)").na.fill("none")) == [("",), ("cba",), ("none",)]
    assert own.described(spark).first()["description"] == "The text from its end."
    spark.sql("drop temporary function backwards")


def test_patch_lines(spark, sql):
    text = "--- a/x\n+++ b/y\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n\\ No newline\n@@ -9 +9 @@\n+z\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-old\n"
    spark.createDataFrame([(1, text), (2, None), (3, "no patch\n+x"), (4, "")], "patch_id int, text string").createOrReplaceTempView("some_patches")
    got = rows(sql("select * from patch_lines(table(some_patches))"))
    assert got == [(1, "gone", 3, 12, "-old"), (1, "y", 1, 3, " a"), (1, "y", 1, 4, "-b"), (1, "y", 1, 5, "+c"), (1, "y", 2, 8, "+z")]
    assert sql("select patch_id from patch_lines(table(select 'a' as patch_id, 'x' as text))").schema["patch_id"].dataType.simpleString() == "string"
    assert sql("select * from patch_lines(table(select * from some_patches where false))").count() == 0
    for bad, told in (("patch_lines(table(select 1 as patch_id))", "text"), ("patch_lines('x')", "reads a table")):
        with pytest.raises(Exception, match=told):
            sql(f"select * from {bad}").collect()


def test_reached_and_scalars(spark, sql):
    spark.sql("create or replace temp view links as select * from values ('a', 'b'), ('b', 'a'), ('b', 'c'), ('c', 'd') t(name, other)")
    REGISTRY.install(spark, replace=True)
    assert rows(spark.sql("select * from reached('a', 2)")) == [("a", 0), ("b", 1), ("c", 2)]
    spark.catalog.dropTempView("links")
    assert "reached" not in REGISTRY.install(spark, replace=True)
    with pytest.raises(ValueError, match="'reached' reads links"):
        REGISTRY.install(spark, ["reached"], replace=True)
    spark.sql("create or replace temp view links as select * from values ('a', 'b') t(name, other)")
    assert "reached" in REGISTRY.install(spark, replace=True)
    assert rows(spark.sql("select * from reached('a', 0)")) == [("a", 0)]
    assert rows(spark.sql("select round(cosine(array(3d, 4d), array(4d, 3d)), 9), cosine(array(0d), array(1d)), clipped('abcdef', 3), clipped('ab', 3), clipped('ab', 0)")) == [(0.96, 0.0, "ab…", "ab", "")]
    described = REGISTRY.described(spark)
    assert {r["name"] for r in described.collect()} >= {"dot", "cosine", "clipped", "reached", "patch_lines"}
    assert described.filter("name = 'cosine'").first()["needs"] == ["dot"]
