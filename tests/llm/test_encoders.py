"""Piece encoding, the Merkle manifest and tokenizer alignment against plain versions; neighbours and duplicates of rows that are easily got wrong."""

import hashlib
import json
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basalt.llm import align, catalog, exact, merkle, pieces, vptree
from basalt.llm.common import cut

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977} und\r\n" if i % 50 == 0 else f"w{i % 97}" for i in range(40_000))
TEXTS = [
    None, "", " \t\n", "A b c", "a  B\tc", "Größe NAÏVE don't 'tis x²½ ｆｕｌｌ    é <|endoftext|> </s> <0x41> \x1c\x85z", "日本語 の テキスト 😀😀",
    LONG, LONG, " " * 5000 + "x", "literal ▁ sign", "the same text", "the same text", "\x00 nul", "a;\r\nb\r\r c ",
]
LETTERS = ["a", "b", "the", " ", "  ", "\n", "é", "日", "\r", "▁", "ing", "0", "12", "\t", " " * 9, "=", "*/", "😀", "\x00", "th", "e", "\xa0", "'s", "<|endoftext|>", "</s>", "\x85", "　", ";\r", "\x1c"]


def odd_rows(spark):
    """Nulls in any column, repeated rows, one id twice, and columns that are named like the operators' own."""
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (7, "another text of id seven", "de", "s", 1), (-(2**63), "smallest id", "", "s", None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "tree", "leaf", "pos", "n", "level", "root", "key", "copies", "pairs", "ids", "n_a", "bundle", "of", "text_", "at", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    return cut(df.repartition(3))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(PIECES)


# Piece encoding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("".join(sorted(set("".join(LETTERS)))))) | st.lists(st.sampled_from(LETTERS), max_size=30).map("".join), min_size=1, max_size=4))
def test_pieces_equal_the_library(library, encoder, some):
    for text, (_, ids) in zip(some, pieces.encoded_together(encoder, some)):
        assert ids.tolist() == library.encode(text)
        parts = [(i, encoder.ids.take(encoder.rows(part))[0].tolist()) for i, part in enumerate(encoder.parts(text, 3))]
        assert [x for _, part in parts for x in part] == library.encode(text)
        assert "".join(encoder.decode(part, i == 0) for i, part in parts) == library.decode(library.encode(text))


def test_pieces_of_every_vocabulary_entry_joined_to_others(library, encoder):
    entries = [p.replace(pieces.SPACE, " ") for p in encoder.vocabulary.number]
    some = [a + b for a, b in zip(entries, entries[7919:] + entries[:7919])]
    assert [ids.tolist() for _, ids in pieces.encoded_together(encoder, some)] == library.encode(some)


def test_pieces_of_very_long_words_and_runs(library, encoder):
    for text in (" " * 100_003 + "x", "a" * 100_000, "\n" * 50_000, "the" * 50_000, "ab " * 50_000, "日" * 40_000):
        ids = [i for part in encoder.parts(text) for i in encoder.ids.take(encoder.rows(part))[0].tolist()]
        assert ids == library.encode(text)


def test_piece_round_trip_on_odd_rows(spark, library):
    got = pieces.piece_round_trip(odd_rows(spark), PIECES).toPandas()
    ids = [library.encode(r["text"] or "") for r in odd_rows(spark).collect()]
    want = sorted((len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for x in ids)
    assert sorted(zip(got.n_tokens, got.ids_sha256, got.decoded_sha256)) == want
    assert pieces.piece_round_trip(odd_rows(spark).limit(0), PIECES).count() == 0
    encoded = pieces.piece_encode(odd_rows(spark), PIECES)
    assert sorted(tuple(r["ids"]) for r in encoded.collect()) == sorted(map(tuple, ids))
    assert sorted(r["text"] for r in pieces.piece_decode(encoded, PIECES).collect()) == sorted(map(library.decode, ids))


# Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Leaf by leaf, with lists: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for d, text, lang, source, n in rows:
        head = "".join(map(spell, (d, source, lang, n)))
        leaf = digest(head, spell(text))
        changed = digest(head, spell(lower(text))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        trees.setdefault(lang, []).append((d, leaf, changed))

    def climb(nodes):
        """The last node, and for each first one its steps: the siblings left and right."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
                steps[i].append((run[: p % 8], run[p % 8 + 1 :]))
            nodes, at = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], steps

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        own[x] = climb([r[1] for r in trees[x]])
    root, above = climb([own[x][0] for x in langs])
    out = []
    for x, up in zip(langs, above):
        for (d, leaf, changed), steps in zip(trees[x], own[x][1]):
            node = changed
            for before, after in steps + up:
                node = digest(*before, node, *after)
            out.append((d, leaf, own[x][0], root, digest(*(s for b, a in steps + up for s in b + a)), node, node == root))
    return Counter(out)


def manifest_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return Counter(tuple(r) for r in merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_of_odd_rows(spark):
    rows = [tuple(r) for r in odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = merkle.manifest(odd_rows(spark)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(rows)
    assert merkle.manifest(odd_rows(spark).limit(0)).count() == 0
    con = duckdb.connect()
    con.register("documents", odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    assert Counter(con.execute(catalog.OP12_SQL).fetchall()) == plain_manifest(rows)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"": 65, "a": 64, "b": 1}, {f"l{i:02}": 1 + i % 3 for i in range(20)}])
def test_manifest_of_trees_of_all_depths(spark, sizes):
    rows = [(1000 * k + i, f"Text {i}", lang, "s", i) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_with_salted_nodes(spark):
    """More than 512 runs, so that nodes near the root are stored for several salts; one lang holds most rows."""
    rows = [(i, f"Text {i}", "en" if i % 10 else f"x{i % 7}", None, i) for i in range(4700)]
    assert manifest_of(spark, rows) == plain_manifest(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


# Alignment


def letters_of_bytes():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@pytest.fixture(scope="module")
def plain_aligned(library):
    tokenizer, of = Tokenizer.from_file(BYTES), letters_of_bytes()
    tokenizer.encode_special_tokens = True
    spelt = {i: bytes(of[c] for c in t) for t, i in tokenizer.get_vocab().items() if all(c in of for c in t)}

    def align_one(text):
        """n_a, n_b, groups as text and links."""
        whole = (" " + (text or "")).encode()
        a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, library.encode(text or "")
        a_bytes = [spelt[i] for i in a]
        b_bytes = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace(pieces.SPACE, " ").encode() for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return 0, 0, "", []
        ends = [dict(zip(np.cumsum([len(x) for x in t]).tolist(), range(len(t)))) for t in (a_bytes, b_bytes)]
        groups, links, i, j = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][e] + 1, ends[1][e] + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        return len(a), len(b), ";".join(groups), links

    return align_one


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(BYTES, PIECES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), min_size=1, max_size=40).map("".join), st.sampled_from([1, 3, 1000]))
def test_alignment_of_one_text(aligner, plain_aligned, text, most):
    n_a, n_b, digest_, pairs = aligner.of(text, most)
    a, b, groups, links = plain_aligned(text)
    assert (n_a, n_b, digest_) == (a, b, hashlib.sha256(groups.encode()).hexdigest() if a else "")
    assert Counter(pairs.tolist()) == Counter((x << align.BITS) + y for x, y in links)


def corpus(plain_aligned, rows):
    """What the operator returns, from the links of all rows."""
    found = [(d, plain_aligned(t)) for d, t in rows]
    counts = Counter(x for _, (_, _, _, links) in found for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return Counter(
        (d, a, b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if a else "") for d, (a, b, groups, links) in found
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("bundle", [1, 2000, 16 << 20])
def test_alignment_on_odd_rows(spark, plain_aligned, bundle):
    rows = [(r["doc_id"], r["text"]) for r in odd_rows(spark).collect()]
    got = align.aligned(odd_rows(spark), BYTES, PIECES, bundle_bytes=bundle).select(*COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == corpus(plain_aligned, rows)
    assert align.aligned(odd_rows(spark).limit(0), BYTES, PIECES).count() == 0


def test_alignment_of_documents(spark, sf_dir, plain_aligned):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = docs.unionByName(docs.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 10_000))
    got = align.aligned(copies.repartition(5), BYTES, PIECES, bundle_bytes=100_000).select(*COLUMNS)
    assert Counter(tuple(r) for r in got.collect()) == corpus(plain_aligned, [(r["doc_id"], r["text"]) for r in copies.collect()])


# Rows of one id, and the smallest id


def test_neighbours_keep_rows_of_one_id(spark):
    rows = [(0, [0.0, 1.0]), (1, [0.0, 1.1]), (1, [0.0, 1.1]), (1, [5.0, 5.0]), (2, [0.0, 1.2]), (100, [3.0, 3.0]), (100, [3.0, 3.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((math.dist(x, y), c) for j, (c, y) in enumerate(rows) if j != i)
            want += [(q, k, c, round(d, 9)) for k, (d, c) in enumerate(near, 1)]
    for shard_rows in (2, 4096):
        got = vptree.nearest(v, shard_rows=shard_rows).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)
    con = duckdb.connect()
    con.register("embeddings", v.toArrow())
    same(vptree.nearest(v), con, catalog.OP8_SQL)


def test_neighbours_of_given_queries_may_be_rows_of_their_id(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    got = vptree.nearest(v, queries=v.filter("vec_id = 7"), k=3).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 7), (2, 6), (3, 8)]


def test_exact_groups_of_the_smallest_and_largest_id(spark):
    low, high = -(2**63), 2**63 - 1
    rows = spark.createDataFrame([(high, "a b"), (low, "ab "), (5, "ab"), (None, "a  b  ")], "doc_id long, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_groups(rows).collect()}
    assert got == {(high, None, 4, False), (low, None, 4, False), (5, None, 4, False), (None, None, 4, True)}
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.exact_groups(rows.filter("doc_id is not null")).collect()}
    assert got == {(high, low, False), (low, low, True), (5, low, False)}


def test_model_files_that_follow_other_rules_are_refused():
    class Other:
        def serialized_model_proto(self):
            from sentencepiece import sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto()
            proto.ParseFromString(open(PIECES, "rb").read())
            proto.normalizer_spec.remove_extra_whitespaces = True
            return proto.SerializeToString()

    with pytest.raises(ValueError):
        pieces._only_plain_bpe(Other())


def test_ids_of_the_byte_vocabulary_are_one_to_one(aligner):
    vocabulary = json.load(open(BYTES))["model"]["vocab"]
    of = letters_of_bytes()
    assert all(aligner.a_bytes[i] == bytes(of[c] for c in t) for t, i in vocabulary.items() if all(c in of for c in t))


def test_units_met_once_are_forgotten_first(plain_aligned):
    own = align.Aligner(BYTES, PIECES, room=10)
    text = "one two three one two four five six seven eight nine ten eleven twelve"
    first = own.of(text)[:3]
    assert own.units.full(own.room)
    own.make_room()
    assert set(own.units) == {" one", " two"}
    a, b, groups, _ = plain_aligned(text)
    assert own.of(text)[:3] == first == (a, b, hashlib.sha256(groups.encode()).hexdigest())
    own.room = 1
    own.make_room()
    assert not own.units
