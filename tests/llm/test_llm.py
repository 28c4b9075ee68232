"""The operators against plain versions, and on rows that are easily got wrong."""

import base64
import functools
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm.common import cut, joined_evenly, slices
from basalt.llm import bpe, catalog, components, exact, gru, labelled, language, packing, quality, recurrent, simhash, tokens, toxicity, vptree, words

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(f"w{i % 977} und" for i in range(40_000))
TEXTS = [
    None, "", " \t\n", "A b c", "a  B\tc", "a b d", "Größe NAÏVE don't 'tis x²½ ｆｕｌｌ    é <|endoftext|> \x1c\x85z", "日本語 の テキスト 😀😀", LONG, LONG, "!!! 123 ...", "the same text", "the same text", "the  same text ",
]


def odd_rows(spark):
    """Nulls in any column, repeated rows, one id twice, and columns that are named like the operators' own."""
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (7, "another text of id seven", "de", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row_id", "fp", "fingerprint", "component_id", "kept", "held_out", "score", "p", "ids", "start", "length", "bucket", "n", "tie", "shard", "word", "y", "part", "same", "h", "pos", "near_row", "exact_row", "language_told", "toxicity_told", "piece", "hot", "cell", "size"):
        df = df.withColumn(c, F.lit("clash"))
    return cut(df.repartition(3))


def empty(spark):
    return odd_rows(spark).limit(0)


def frame(df):
    return df.toPandas()


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


# Byte-level BPE


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z9'\n\t\r é日  !?-\x1c\x85"), max_size=300))
def test_bpe_cut_texts_encode_as_whole_ones(text):
    enc = bpe.encoding(RANKS, P.PATTERN)
    assert bpe.encode(enc, text, long=5, run=3).tolist() == enc.encode_ordinary(text)
    assert bpe.decode(enc, bpe.encode(enc, text)) == text.encode()


def test_bpe_very_long_runs():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for text in (" " * 1_000_000 + "x", "a" * 300_000, "\n" * 50_000, "x y " * 100_000):
        assert bpe.decode(enc, bpe.encode(enc, text)) == text.encode()
    assert bpe.encode(enc, "x y " * 30_000).tolist() == library().encode_ordinary("x y " * 30_000)


def test_bpe_query_on_odd_rows(spark):
    enc, got = library(), frame(bpe.bpe_round_trip(odd_rows(spark), RANKS, P.PATTERN))
    want = sorted((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in frame(odd_rows(spark)).text for ids in [enc.encode_ordinary(t or "")])
    assert sorted(zip(got.n_tokens, got.ids_sha256, got.decoded_sha256)) == want
    assert bpe.bpe_round_trip(empty(spark), RANKS, P.PATTERN).count() == 0
    back = frame(bpe.bpe_decode(bpe.bpe_encode(odd_rows(spark), RANKS, P.PATTERN), RANKS, P.PATTERN))
    assert sorted(bytes(x) for x in back.content) == sorted((t or "").encode() for t in frame(odd_rows(spark)).text)


# Word tokenizer, token files, packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abÄßÿ×µΣσ1'.,-!\n \t ́\x1c<|>endoftext日"), max_size=60), max_size=4))
def test_word_encoder_equals_the_library(texts):
    tokenizer, encoder = Tokenizer.from_file(WORDS), words.word_encoder(WORDS)
    flat, lens = encoder(texts)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [i for x in want for i in x] and lens.tolist() == [len(x) for x in want]


def test_words_that_recur_are_not_encoded_again(tokenizer):
    encoder, learned = words.WordEncoder(WORDS, room=60), []
    learn = encoder._learn
    encoder._learn = lambda new: (learned.extend(new), learn(new))
    for i in range(30):
        texts = [" ".join(["Both same, Größer!", "isn't", *(chr(97 + i % 26) * 3 + chr(97 + k) * (i // 26 + 1) for k in range(26))]), None, " "]
        flat, lens = encoder(texts)
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert flat.tolist() == [x for ids in want for x in ids] and lens.tolist() == [len(x) for x in want]
    assert {learned.count(w.encode()) for w in ("Both", "same,", "Größer!", "isn't")} == {1}
    assert len(encoder.words.numbers) < 120 and encoder.merger is not encoder.tokenizer


def whole_ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_on_odd_rows(spark, tmp_path, tokenizer):
    path = str(tmp_path / "t.orc")
    tokens.write_token_files(odd_rows(spark), path, WORDS, shards=3)
    files = tokens.read_token_files(spark, path)
    got = frame(tokens.token_index(files)).sort_values("start")
    source = frame(odd_rows(spark))
    assert sorted(got.ids_crc32) == sorted(zlib.crc32(whole_ids(tokenizer, t, 1).tobytes()) for t in source.text)
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    ids = got.doc_id.fillna(-1).tolist()
    assert ids == sorted(ids)
    assert files.filter("doc_id = 3").count() == 3
    tokens.write_token_files(empty(spark), str(tmp_path / "e.orc"), WORDS, shards=2)
    assert tokens.token_index(tokens.read_token_files(spark, str(tmp_path / "e.orc"))).count() == 0


def check_packed(got, capacity):
    """Every id of every document once, sequences without gaps, and the padding."""
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= capacity and (own.length > 0).all()
    lengths = got.groupby("sequence_id").length.sum()
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def test_packing_on_odd_rows(spark, tokenizer):
    rows = odd_rows(spark)
    for capacity in (4096, 64):
        got = frame(packing.pack(rows, WORDS, capacity=capacity))
        got["crc"] = [zlib.crc32(bytes(x)) for x in got.ids]
        source = frame(rows)
        want = Counter()
        for doc, text in zip(source.doc_id, source.text):
            want.update((int(doc) if doc == doc else -1, i) for i in whole_ids(tokenizer, text, 2).tolist())
        have = Counter((int(r.doc_id) if r.doc_id == r.doc_id else -1, int(i)) for r in got.itertuples() for i in np.frombuffer(bytes(r.ids), "<u4"))
        assert have == want
        assert all(len(r.ids) == 4 * r.length for r in got.itertuples())
        assert check_packed(got, capacity) == 0
        one = got[got.doc_id == 8].sort_values("start")
        assert np.array_equal(np.concatenate([np.frombuffer(bytes(x), "<u4") for x in one.ids]), whole_ids(tokenizer, LONG, 2))
    assert packing.pack(empty(spark), WORDS).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(histogram):
    plan = packing.Plan(histogram, 64)
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64) if histogram else np.zeros(0, np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()]).astype(np.int64) if histogram else np.zeros(0, np.int64)
    to = pd.DataFrame(plan.place(length, rank))
    assert to.groupby("piece").length.sum().tolist() == length.tolist()
    padding = 0
    for _, own in to.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        n = int(own.length.sum())
        padding += 0 if n & (n - 1) == 0 else 64 - n
    assert padding == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fill_comes_closest(counts, room):
    chosen = packing.fill(counts, room)
    assert all(counts[x] >= k for x, k in chosen.items())
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1) if s + x * k <= room}
    assert sum(x * k for x, k in chosen.items()) == max(sums)


# Exact and near duplicates


def plain_exact(rows):
    norm = [(t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}) for t in rows.text]
    groups = {}
    for i, x in enumerate(norm):
        groups.setdefault(x, []).append(i)
    out = []
    for x, own in groups.items():
        best = min(own, key=lambda i: (-len(rows.text[i] or ""), rows.doc_id[i] if rows.doc_id[i] == rows.doc_id[i] else math.inf))
        out += [(rows.doc_id[i], rows.doc_id[best], len(own), hashlib.sha256(x.encode()).hexdigest()) for i in own]
    return out


def comparable(rows):
    """Rows as text, whichever kind of number they hold; -1 for a null."""
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return sorted(str(tuple(-1 if v != v else plain(v) for v in r)) for r in rows)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
def test_exact_groups_on_odd_rows(spark, hashed):
    """Also with a hash that nearly always collides: identifiers are verified."""
    got = frame(exact.exact_groups(odd_rows(spark), least=3, most=12, hashed=hashed))
    assert comparable(zip(got.doc_id, got.keep_id, got.group_size, got.text_sha256)) == comparable(plain_exact(frame(odd_rows(spark))))
    assert got.groupby("text_sha256").kept.sum().eq(1).all()
    assert (got[got.kept].doc_id.fillna(-1) == got[got.kept].keep_id.fillna(-1)).all()
    assert exact.exact_groups(empty(spark)).count() == 0
    assert exact.exact_groups(odd_rows(spark).repartition(5), least=3, most=12, hashed=hashed).filter("kept").count() == got.text_sha256.nunique()
    assert exact.exact_distinct(odd_rows(spark)).columns == odd_rows(spark).columns
    assert exact.exact_distinct(odd_rows(spark)).count() == got.text_sha256.nunique()


def test_chunks_are_found_again_after_an_insertion(spark, sf_dir):
    text = "".join("".join(r["text"].split()) for r in documents(spark, sf_dir).orderBy("doc_id").limit(10).collect())[:20000]
    rows = spark.createDataFrame([(text,), ("x" + text,)], "t string").select(exact.chunks(F.col("t"), 50, 400).alias("c"))
    a, b = (r["c"] for r in rows.collect())
    assert "".join(a) == text and "".join(b) == "x" + text and len(set(a) & set(b)) > 0.8 * len(a)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("at_once", [1, 7, 1 << 17])
def test_fingerprints_do_not_depend_on_how_many_hashes_are_added_at_once(at_once):
    rng = random.Random(5)
    texts = [*TEXTS, *(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 90))) for _ in range(60))]
    texts = [t for t in texts if t != LONG or at_once > 100]
    got = simhash.fingerprints_of([t.encode() if t is not None else None for t in texts], at_once=at_once)
    assert got.tolist() == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints_of([]).tolist() == []


def test_near_groups_on_odd_rows(spark):
    rows = frame(odd_rows(spark))
    fps = [plain_fingerprint(t) for t in rows.text]
    of = plain_components(fps)
    least = {}
    for d, f in zip(rows.doc_id, fps):
        if d == d:
            least[of[f]] = min(least.get(of[f], math.inf), d)
    want = comparable((d, f"{f:016x}", least.get(of[f], math.nan)) for d, f in zip(rows.doc_id, fps))
    got = frame(simhash.near_groups(odd_rows(spark)))
    assert comparable(zip(got.doc_id, got.fingerprint, got.component_id)) == want
    assert simhash.near_groups(empty(spark)).count() == 0
    kept = simhash.near_distinct(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns and kept.count() == len(set(of.values()))


def test_links_equal_all_pairs(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    for f in list(fps)[:60]:
        g = f
        for b in rng.sample(range(64), rng.randint(1, 5)):
            g ^= 1 << b
        fps.add(g)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {(r["a"], r["b"]) for r in simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, None)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


# Language, quality, toxicity


def test_forward_sums_all_segmentations():
    known = language.pieces(RANKS)
    rng = np.random.default_rng(0)
    prob = np.append(rng.random(len(known)) / 1000, 0)[:, None]
    of = {p: prob[i, 0] for i, p in enumerate(known)}

    @functools.cache
    def total(word):
        return 1.0 if not word else sum(of.get(word[:n], 0.0) * total(word[n:]) for n in range(1, len(word) + 1))

    for w in ("a", "the", "größe", "überraschung", "日本", "использовать", "internationalization"):
        assert language.word_scores([w], RANKS, prob)[0, 0] == pytest.approx(math.log(total(b" " + w.encode())))
    assert np.isfinite(language.word_scores(["x" * 5000], RANKS, prob)).all()
    weights, got = np.array([2.0]), language.expected_counts(["then"], np.array([2.0]), RANKS, prob)
    assert sum(len(known[i]) * got[i] for i in np.flatnonzero(got)) == pytest.approx(5 * weights[0])


def test_language_on_held_out_documents(spark, sf_dir):
    got = frame(language.identify(documents(spark, sf_dir), RANKS)).merge(frame(documents(spark, sf_dir))[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.95


def test_numerals_are_no_letters():
    assert language.words_of("½ ² Ⅷ 12 _ x² Été") == ["x²", "été"]


def test_language_on_odd_rows(spark):
    got = frame(language.identify(odd_rows(spark), RANKS))
    assert len(got) == odd_rows(spark).count() and got.score.between(0, 1).all()
    texts = frame(odd_rows(spark)).text
    assert (got.lang_pred == "und").sum() == sum(not any(c.isalpha() for c in t or "") for t in texts)
    assert language.identify(empty(spark), RANKS).count() == 0
    assert language.languages_known(odd_rows(spark), RANKS).columns == odd_rows(spark).columns


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBc 12!?-é"), max_size=60), max_size=4))
def test_pooled_words_equal_plain_sums(texts):
    index = quality.Index(buckets=64, width=8)
    split = [[b for w in t.split() for b in index.of_word(w)] for t in texts]
    want = np.zeros((64, 9))
    for seq in split:
        for i, b in enumerate(seq):
            want[b, -1] += 1
            for j in range(max(0, i - 2), min(len(seq), i + 3)):
                if j != i:
                    want[b, :-1] += index.vectors[seq[j]]
    got = quality.context_sums(texts, index)
    assert np.allclose(got, want)
    assert all(np.allclose(quality.context_sums(texts, index, at_once=n), want) for n in (1, 2, 5))
    pooler = quality.Pooler(index, got)
    x = pooler.features(texts, {})
    assert all(np.allclose(pooler.features(texts, {}, at_once=n), x) for n in (1, 2, 5))
    for row, t, seq in zip(x, texts, split):
        plain = np.zeros(pooler.width)
        if seq:
            words_ = t.split()
            plain[:-1] = sum(pooler.vectors[b] for b in seq) + sum(a == b for a, b in zip(words_, words_[1:])) * pooler.vectors[index.repeat]
            plain[:-1] /= len(seq)
            plain[-1] = math.log1p(len(seq))
        assert np.allclose(row, plain, atol=1e-4)


def test_the_network_equals_plain_layers_and_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.Network().fit(x, y, np.arange(4000) % 5 == 0)
    w1, b1, w2, b2 = net.weights
    for row, p in zip(x[:20], net.score(x[:20])):
        hidden_ = [math.tanh(sum((row[i] - net.mean[i]) / net.sd[i] * w1[i, j] for i in range(3)) + b1[j]) for j in range(net.hidden)]
        z = sum(h * w for h, w in zip(hidden_, w2)) + b2[0]
        assert p == pytest.approx(1 / (1 + math.exp(-z / net.temperature)))
    assert ((net.score(x) > 0.5) == y).mean() > 0.95


def plain_features(lexicon, text, window=5):
    own = (text or "").split()
    if not own:
        return [0.0] * len(toxicity.FEATURES)
    cores = [toxicity.plain(w) for w in own]
    weight = [max([lexicon.get(e, 0.0) for e in toxicity.entries(c)] or [0.0]) for c in cores]
    hit, second, n = [w > 0 for w in weight], [c in toxicity.SECOND_PERSON for c in cores], len(own)
    near = sum(h and any(second[max(0, i - window) : i + window + 1]) for i, h in enumerate(hit))
    count = lambda f: sum(f(c) for w in own for c in w)
    letters, chars = max(1, count(str.isalpha)), max(1, count(lambda c: True))
    shout = sum(sum(map(str.isalpha, w)) > 2 and sum(map(str.isalpha, w)) == sum(map(str.isupper, w)) for w in own)
    hidden_ = sum(any(map(str.isalpha, w)) and toxicity.INSIDE.search(w) is not None for w in own)
    drawn = sum(toxicity.THRICE.search(w.lower()) is not None for w in own)
    return [
        sum(hit) / n, sum(weight) / n, max(weight), math.log1p(sum(hit)), math.log1p(len({w for w, h in zip(own, hit) if h})), sum(second) / n, near / n, math.log1p(near),
        count(str.isupper) / letters, shout / n, count(lambda c: not c.isalnum()) / chars, count(lambda c: c == "!") / n, hidden_ / n, drawn / n, chars / n, math.log1p(n),
    ]


def test_toxicity_features_equal_plain_ones():
    lexicon, rng = {"idiot": 3.0, "moro-": 2.0, "dumm": 2.5}, random.Random(3)
    some = ["you", "IDIOT!!", "m-o-r-o-n", "Hello", "du", "dumm", "x1y", "soooo", "fine", "ID1OT", "é", "..."]
    texts = [None, "", " ", *(" ".join(rng.choice(some) for _ in range(rng.randrange(1, 40))) for _ in range(50))]
    got = toxicity.Features(lexicon)(texts, {})
    assert np.allclose(got, [plain_features(lexicon, t) for t in texts], atol=1e-5)
    assert all(np.allclose(toxicity.Features(lexicon)(texts, {}, at_once=n), got) for n in (1, 7))


@pytest.mark.parametrize("rows, size", [(1, 100), (3, 5), (256, 0), (256, 1 << 23)])
def test_slices_hold_every_text_once_in_order(rows, size):
    texts = [None, "", "abc", "é" * 4, None, "x" * 50, "", "ab", "c"]
    got = [x.to_pylist() for x in slices(pa.array(texts, pa.string()), rows, size)]
    assert [t for x in got for t in x] == texts and all(len(x) <= rows for x in got)
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x) <= size for x in got)
    assert list(slices(pa.array([], pa.string()), rows, size)) == []


def test_boosted_trees_split_best_and_add_up():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = ((x[:, 1] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    trees = toxicity.Boosted(trees=5, depth=2, least=5).fit(x, y)
    share, gains = y.mean(), {}
    g, h = y - share, np.full(200, share * (1 - share))
    for j in range(3):
        for cut_ in range(8):
            left = x[:, j] <= cut_
            if 5 <= left.sum() <= 195:
                gains[j, cut_] = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))
    feature, limit, _ = trees.forest[0]
    assert (feature[0], int(limit[0])) == max(gains, key=gains.get)

    def walked(row):
        z = trees.start
        for feature, limit, values in trees.forest:
            node = 0
            for _ in range(2):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            z += values[node - 3]
        return z

    assert trees.raw(x[:50]) == pytest.approx([walked(r) for r in x[:50]])


def held_out_auc(got, labels_, label):
    m = got.merge(labels_.groupby("doc_id").max().reset_index(), on="doc_id")
    m = m[m.held_out]
    rank, y = m.score.rank(), m[label]
    return (rank[y > 0].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("scores, label, least", [(quality.quality_scores, "quality", 0.9), (toxicity.toxicity_scores, "toxic", 0.8)])
def test_scores_on_held_out_labels(spark, scores, label, least):
    d = "/root/testdata/sf0.01"
    got = frame(scores(documents(spark, d), labels(spark, d)))
    assert got.score.between(0, 1).all() and len(got) == documents(spark, d).count()
    assert held_out_auc(got, frame(labels(spark, d)), label) >= least


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_on_odd_rows(spark, scores):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    for labelled_ in (none, some):
        got = frame(scores(odd_rows(spark), labelled_))
        assert len(got) == odd_rows(spark).count() and got.score.between(0, 1).all()
        assert scores(empty(spark), labelled_).count() == 0
    assert toxicity.clean(odd_rows(spark), none).count() == odd_rows(spark).count()


def test_labels_of_the_held_out_fold_play_no_part(spark, sf_dir):
    d, own = documents(spark, sf_dir), labels(spark, sf_dir)
    got = labelled.labelled_sample(d, own, "toxic", 10_000)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in got.collect())


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    z = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * z))).astype(float)
    p = toxicity.Isotonic(z, y)(np.sort(z))
    assert (np.diff(p) >= -1e-12).all() and p.mean() == pytest.approx(y.mean())


def test_hidden_words_are_read():
    assert [toxicity.plain(w) for w in ("ID1OT!!", "m-o-r-o-n", "stuuuupid", "cl0wn,", "l_o_s_e_r")] == ["idiot", "moron", "stupid", "clown", "loser"]


# Recurrent model


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = gru.Gru(40, width=4, hidden=5)
    docs = [np.append(rng.integers(0, 40, n), model.end) for n in (7, 3, 5)]
    docs[0][2] = model.rest
    lanes = gru.Lanes(docs, 2, model.end)
    loss = lambda: -sum(model.log_probabilities(docs, 2)) / sum(map(len, docs))
    grads, _ = model._gradients(lanes.given, lanes.keep, lanes.target, np.zeros((2, 5), np.float32))
    for name, g in zip(model.NAMES, grads):
        w = getattr(model, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, h = w[at], 1e-2
        w[at] = old + h
        up = loss()
        w[at] = old - h
        down = loss()
        w[at] = old
        assert (up - down) / (2 * h) == pytest.approx(float(g[at]), rel=0.05, abs=2e-4)


def test_probabilities_of_all_next_words_sum_to_one():
    for words_ in (50, 1, 1300):
        model = gru.Gru(words_)
        begun = np.array([min(3, words_ - 1), model.rest])
        total = sum(math.exp(p) for p in model.log_probabilities([np.append(begun, w) for w in [*range(words_), model.rest, model.end]])) / math.exp(model.log_probabilities([begun])[0])
        assert total == pytest.approx(1, abs=1e-4)


def test_lanes_and_windows_do_not_change_scores():
    rng = np.random.default_rng(1)
    model = gru.Gru(1024)
    docs = [np.append(rng.integers(0, 1024, n), model.end) for n in (300, 1, 20, 20, 77)]
    alone = [model.log_probabilities([d], 1, 7)[0] for d in docs]
    assert model.log_probabilities(docs, 3, 64) == pytest.approx(alone, rel=1e-4)


def test_lm_words_are_looked_up_once_a_batch():
    """The words are those of bytes.split(), with A-Z in lower case; each distinct one is asked for once."""
    texts = [b" The\x0bCAT\x1cx\x0c\x85 \xc2\xa0\xc3\x89 \r\n", None, b"", b" \t", b"the cat the", b"\xff\xfe THE", b"z" * 5000]
    for own in (texts, texts[1:4], [b"a b a"], []):
        distinct, places, counts = recurrent.words_of(pa.array(own, pa.binary()))
        want = [(t or b"").lower().split() for t in own]
        assert [distinct[i].as_py() for i in places.tolist()] == [w for ws in want for w in ws] and counts.tolist() == [len(ws) for ws in want]
        assert sorted(distinct.to_pylist()) == sorted({w for ws in want for w in ws})
    words_, places, counts = recurrent.words_of(pa.array([b"the cat the", None, b"dog"]))
    coder, model = recurrent.Coder({b"the": 5, b"dog": 2}, [b"the"]), gru.Gru(1)
    rows = coder(words_)
    assert rows.tolist() == [0, -1, 1]
    assert [d.tolist() for d in coder.docs(rows[places], counts, model)] == [[0, model.rest, 0, model.end], [model.end], [model.rest, model.end]]


def test_lm_scores_on_odd_rows(spark):
    rows = frame(odd_rows(spark))
    held = [d == d and zlib.crc32(str(int(d)).encode()) % 7 == 2 for d in rows.doc_id]
    texts = [(t or "").encode().lower().split() for t in rows.text]
    counts = Counter(w for d, h, t in zip(rows.doc_id, held, texts) if d == d and not h for w in [*t, None])
    n, v = sum(counts.values()), len(counts)
    want = comparable((h, len(t) + 1, sum(counts[w] > 0 for w in [*t, None]), n, round(math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*t, None]), 4)) for h, t in zip(held, texts))
    for common in (500_000, 20):
        got = frame(recurrent.lm_scores(odd_rows(spark), common=common))
        assert comparable(zip(got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score.round(4))) == want
        assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert recurrent.lm_scores(empty(spark)).count() == 0


def plain_log10(weights, head, rest_share, words_, hidden=24):
    """The score of one text, word by word, in double precision."""
    model = gru.Gru(len(head), hidden=hidden).with_weights(weights)
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, given, total = np.zeros(hidden), model.end, 0.0
    for w in [*words_, None]:
        x = model.embed[given].astype(float) @ model.into.astype(float) + model.into_b
        own = h @ model.state.astype(float)
        z, r = sig(x[0] + own[0]), sig(x[1] + own[1])
        n = np.tanh(x[2] + r * (own[2] + model.state_b))
        h = n + z * (h - n)
        logits = np.append(h, 1) @ model.klass.astype(float) + model.no_class
        target = model.end if w is None else head.get(w, model.rest)
        k = target // model.side if target < model.rest else target - model.rest + model.side
        total += logits[k] - np.log(np.exp(logits).sum())
        if target < model.rest:
            inner = np.append(h, 1) @ model.word[k].astype(float) + model.no_word[k]
            total += inner[target % model.side] - np.log(np.exp(inner).sum())
        elif w is not None:
            total += math.log(rest_share(w))
        given = target
    return total / math.log(10)


def test_scores_equal_plain_ones_word_by_word(spark, sf_dir, monkeypatch):
    rng, docs = np.random.default_rng(6), documents(spark, sf_dir).limit(60)
    weights = gru.Gru(40).weights() + rng.normal(0, 0.2, gru.Gru(40).weights().size).astype(np.float32)
    monkeypatch.setattr(recurrent, "train", lambda *a: weights)
    rows = frame(docs)
    split = [(t or "").encode().lower().split() for t in rows.text]
    counts = Counter(w for d, ws in zip(rows.doc_id, split) if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    head = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:40])}
    rest = sum(n + 1 for w, n in counts.items() if w not in head) + 1
    tokens_ = sum(counts.values()) + len(split)
    for common in (1_000_000, tokens_ // min(counts[w] for w in head) + 1):  # all words are sent, or little more than the head
        got = dict(frame(recurrent.lm_scores(docs, head_words=40, common=common)).set_index("doc_id").score)
        for d, ws in zip(rows.doc_id, split):
            assert got[d] == pytest.approx(plain_log10(weights, head, lambda w: (counts[w] + 1) / rest, ws), rel=2e-4)


def test_the_model_beats_the_base_on_held_out_documents(spark):
    got = frame(recurrent.lm_scores(documents(spark, "/root/testdata/sf0.01")))
    got = got[got.held_out]
    assert got.score.sum() > got.base_score.sum() * 0.97


def test_likelihood_of_held_out_documents_with_the_whole_model(spark):
    got = frame(recurrent.lm_scores(documents(spark, "/root/testdata/sf0.01")))
    got = got[got.held_out]
    assert got.score.sum() / got.n_tokens.sum() > -3.843


# Nearest neighbours


def test_exact_neighbours_and_recall_of_relaxed_ones(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = frame(v)
    x, ids = np.stack(rows.embedding.to_numpy()).astype(float), rows.vec_id.to_numpy()
    want = set()
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want |= {(q, ids[i]) for i in np.lexsort((ids, d))[:10]}
    for factor, least, shard_rows in ((1.0, 1.0, 100), (1.0, 1.0, 7), (1.0, 1.0, 4096), (1.2, 0.9, 100)):
        got = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(v, factor=factor, shard_rows=shard_rows).collect()}
        assert len(got & want) >= least * len(want)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (-8, [0.0, 2.0])] + [(i, [0.5, 0.5]) for i in range(10, 150) if i % 100]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit("clash"))
    got = frame(vptree.nearest(v, shard_rows=50)).sort_values(["query_id", "rank"])
    assert sorted(set(got.query_id)) == [0, 100]
    assert got[got.query_id == 0].vec_id.tolist() == [10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
    assert got[got.query_id == 0]["rank"].tolist() == list(range(1, 11))
    assert vptree.nearest(v.limit(0)).count() == 0


# Queries and pipeline


def test_queries_with_sql_agree(spark, sf_dir):
    from oracle import database, same

    for name, sql in catalog.oracle_sql().items():
        same(catalog.queries()[name](spark, sf_dir), database(sf_dir), sql)


def test_pipeline_stages_in_order(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    columns, rows = docs.columns, frame(docs)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = frame(docs)
            assert set(after.doc_id) <= set(rows.doc_id)
            if name == "exact_dedup":
                assert len(after) == len({"".join(t.split()) for t in rows.text})
            if name == "simhash":
                of = plain_components([plain_fingerprint(t) for t in rows.text])
                least = {}
                for d, t in zip(rows.doc_id, rows.text):
                    root = of[plain_fingerprint(t)]
                    least[root] = min(d, least.get(root, d))
                assert set(after.doc_id) == set(least.values())
            rows = after
    assert set(frame(docs).doc_id) == set(rows.doc_id)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "simhash", "packing"]


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd_rows(spark), empty(spark)):
            got = stage(spark, df, sf_dir)
            assert got.count() >= 0
            if name != "packing":
                assert got.columns == df.columns


@pytest.mark.parametrize("one_of", [exact.exact_distinct, simhash.near_distinct])
def test_distinct_rows_of_an_input_that_comes_in_another_order_each_time(spark, one_of):
    chance = F.udf(lambda: int.from_bytes(os.urandom(6), "big"), "long").asNondeterministic()
    texts = [" ".join(f"{random.Random(i).getrandbits(40):x}{j}" for j in range(30)) for i in range(100)]
    rows = spark.createDataFrame([(i, texts[i % 100]) for i in range(200)], "doc_id long, text string").withColumn("none", F.lit(None))
    mixed = rows.withColumn("chance", chance()).repartition(4, "chance").sortWithinPartitions("chance").drop("chance")
    got = one_of(mixed)
    assert got.columns == mixed.columns
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(100))


def test_distinct_rows_whatever_adaptive_execution_makes_of_them(spark, sf_dir):
    """Chained without Parquet between, joins not broadcast and small partitions put together."""
    docs, fps = frame(documents(spark, sf_dir)), {}
    texts = {}
    for d, t in sorted(zip(docs.doc_id, docs.text), key=lambda r: (-len(r[1] or ""), r[0])):
        texts.setdefault("".join((t or "").split()), (d, t))
    of = plain_components([plain_fingerprint(t) for _, t in texts.values()])
    for d, t in texts.values():
        root = of[plain_fingerprint(t)]
        fps[root] = min(d, fps.get(root, d))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "50"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = simhash.near_distinct(exact.exact_distinct(documents(spark, sf_dir).repartition(7)))
        assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(fps.values())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("most, ways", [(2, 3), (1000, 64), (1, 64)])
def test_even_joins_equal_plain_ones(spark, most, ways):
    rows = cut(spark.createDataFrame([(i, 0 if i % 3 else i % 7) for i in range(90)], "row long, k long"))
    groups = rows.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("size"))
    got = joined_evenly(rows, groups, F.col("k"), F.col("of"), F.col("k") == F.col("of"), "size", "row", most, ways)
    want = rows.join(groups, F.col("k") == F.col("of"))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_run_equals_its_stages_written_one_by_one(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert set(frame(corpus_pipeline.run(spark, sf_dir)).doc_id) == set(frame(docs).doc_id)
