"""The index of three-letter sequences: what patterns need, that no match is lost, and how few texts are read."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.operators import trigrams as tg
from basalt.sources import files

LETTERS = "abAB é.\nβΣ日"
ATOMS = st.sampled_from(["abc", "ab", "a", "b", "B", "Ab", " ", "é", "日本語", "Σ", ".", "[ab]", "[^a]", r"\w", r"\s", "[a-d]", r"\.", "bab", "abba"])


def patterns():
    more = lambda p: st.one_of(
        st.lists(p, min_size=1, max_size=4).map("".join),
        st.lists(p, min_size=2, max_size=3).map(lambda x: f"({'|'.join(x)})"),
        st.tuples(p, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "*?", "+?"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    )
    return st.recursive(ATOMS, more, max_leaves=8)


def holds(condition, grams):
    if condition is None:
        return True
    if isinstance(condition, int):
        return condition in grams
    return (all if condition[0] == "and" else any)(holds(c, grams) for c in condition[1:])


@settings(max_examples=600, deadline=None)
@given(patterns(), st.text(LETTERS, max_size=25), st.booleans())
def test_no_match_is_lost(pattern, text, any_case):
    pattern = f"(?i){pattern}" if any_case else pattern
    found = re.search(pattern, text, re.ASCII)
    grams = set(tg.grams_of(text.lower()).tolist())
    condition = tg.of_pattern(pattern)
    if found and "\n" not in found[0]:
        assert holds(condition, grams)
        assert holds(tg.smaller(condition, 2), grams)


def spelt(condition):
    if isinstance(condition, int):
        return "".join(chr(condition >> k & (1 << 21) - 1) for k in (42, 21, 0))
    return condition if condition is None else (condition[0], *map(spelt, condition[1:]))


def test_what_patterns_need():
    needs = lambda p: spelt(tg.of_pattern(p))
    assert needs("abcd") == ("and", "abc", "bcd")
    assert needs("(?i)ABC") == "abc"
    assert needs("abc.*xyz") == ("and", "abc", "xyz")
    assert needs("(abc|xyz)1") == ("or", ("and", "abc", "bc1"), ("and", "xyz", "yz1"))
    assert needs("colou?r") == ("or", ("and", "col", "olo", "lor"), ("and", "col", "olo", "lou", "our"))
    assert needs("(abc)+") == "abc" and needs("[xy]bc") == ("or", "xbc", "ybc")
    for nothing in ("", "ab", "(abc)*", "abc|x", "a.b.c", "(?=abc)", r"\p{L}bcd", r"\Qabc\E", "[a-z&&[^b]]cde", "(?x)a b c", "(unclosed", "Σas", r"(.)\1"):
        assert needs(nothing) is None, nothing
    assert len(tg.asked_for(tg.smaller(tg.of_string("abcdefghijklmnopqrstuvwxyz0123456789")))) <= tg.ASKED


@pytest.fixture(scope="module")
def index(spark, sf_dir, tmp_path_factory):
    from basalt.plans import tables as tb

    path, rows = str(tmp_path_factory.mktemp("grams") / "index"), tb.files(spark, sf_dir)
    odd = spark.createDataFrame([("none", None, 0), ("empty", "", 0), ("short", "ab", 0), ("two\nlines", "xq\nzk xqz", 0), ("İ", "İstanbul KELVIN ǅungla", 0)], "path string, content string, size long")
    odd = odd.withColumn("mtime", F.timestamp_seconds(F.lit(5)))
    rows = rows.withColumn("size", F.col("size").cast("long")).unionByName(odd)
    tg.build(rows.withColumn("gram", F.lit("clash")), path)
    return path, rows.cache()


@pytest.mark.parametrize("pattern", ["(?i)license", "the [a-z]+tion", "xqz", "q\\nz", "^A", "(de|en) la", ".", "İst", "kelvin", "(?i)kelvin", r"\d{4}-\d\d", "nothing has this"])
def test_same_lines_as_a_scan(spark, index, pattern):
    path, rows = index
    got, want = (sorted(tuple(r) for r in f.collect()) for f in (tg.grep(spark, path, pattern, most=None), files.grep(rows.filter("content is not null"), pattern, most=None)))
    assert got == want
    got, want = ([tuple(r) for r in f.collect()] for f in (tg.grep(spark, path, pattern, "*.txt", 5), files.grep(rows.filter("content is not null"), pattern, "*.txt", 5)))
    assert got == want


@pytest.mark.parametrize("words", ["license", "THE END", "xq\nzk", "i̇stan", "kelvin", "ab", ""])
def test_same_texts_as_a_scan(spark, index, words):
    path, rows = index
    want = rows.filter(F.contains(F.lower("content"), F.lower(F.lit(words))))
    assert sorted(r["path"] for r in tg.holding(spark, path, words).collect()) == sorted(r["path"] for r in want.collect())


def test_few_texts_are_read(spark, index):
    path, rows = index
    n = rows.filter("content is not null").count()
    read = lambda p: tg.texts_of(spark, path, tg.of_pattern(p)).count()
    assert read(".") == n
    assert 0 < read("MIT License") < 0.3 * n
    assert read("nothing has this") == 0
    plan = tg.candidates(spark, path, tg.of_pattern("License"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "slot#" in plan and "PushedFilters: [In(gram" in plan


def test_blocks_and_further_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tg, "BLOCK_TEXTS", 7)
    path = str(tmp_path / "index")
    text = lambda i: (f"f{i}", f"text number{i} of many", None)
    kinds = "path string, content string, mtime timestamp"
    tg.build(spark.createDataFrame([text(i) for i in range(50)], kinds), path)
    tg.extend(spark.createDataFrame([text(i) for i in range(50, 60)], kinds), path)
    got = tg.grep(spark, path, "number[15]\\d", most=None).collect()
    assert sorted(r["path"] for r in got) == sorted(f"f{i}" for i in range(60) if i // 10 in (1, 5))
    empty = str(tmp_path / "empty")
    tg.build(spark.createDataFrame([], kinds), empty)
    assert tg.grep(spark, empty, "abc").count() == 0 and tg.grep(spark, empty, ".").count() == 0


def test_a_block_is_indexed_in_little_more_than_its_sequences(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    stamp = pa.timestamp("us", "UTC")
    held = []
    for i in range(40):
        text = "".join(map(chr, rng.integers(97, 123, 20_000)))
        held.append((pa.record_batch([pa.array([f"p{i}"]), pa.array([text]), pa.array([None], stamp)], names=["path", "content", "mtime"]), tg.grams_of(text)))
    size, sets = sum(g.nbytes for _, g in held), [(t, set(g.tolist())) for t, g in held]
    tracemalloc.start()
    lists: dict = {}
    for batch in tg._block("b", held):
        if batch.column(0)[0].as_py() == "list":
            for gram, docs in zip(batch.column(7).to_numpy(), batch.column(8)):
                assert gram not in lists  # each sequence has one list in a block
                lists[int(gram)] = docs.as_py()
    tracemalloc.stop()
    tracemalloc.start()
    for _ in tg._block("b", held):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lists == {g: [i for i, (_, own) in enumerate(sets) if g in own] for g in set().union(*(own for _, own in sets))}
    assert peak < size  # with all sequences at once it was 4.5 times that
