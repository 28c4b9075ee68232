"""What the operators claim, checked piece by piece: expected counts, packed documents, index of token files, accuracy, contracts of all queries, dirty columns."""

import os
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basalt.llm import catalog, language, packing, quality, tokens, toxicity
from basalt.llm.common import parts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def test_expected_counts_equal_the_sum_over_all_segmentations():
    known = language.pieces(RANKS)
    rng = np.random.default_rng(3)
    prob = np.append(rng.random(len(known)) / 1000, 0)[:, None]
    number = {p: i for i, p in enumerate(known)}

    def segmentations(word):
        if not word:
            yield ()
        for n in range(1, len(word) + 1):
            if word[:n] in number:
                for rest in segmentations(word[n:]):
                    yield (word[:n], *rest)

    for word, weight in (("then", 2.0), ("größe", 3.0), ("日本", 1.0), ("aaaa", 5.0)):
        want, total = np.zeros(len(prob)), 0.0
        for seg in segmentations(b" " + word.encode()):
            p = np.prod([prob[number[x], 0] for x in seg])
            total += p
            for x in seg:
                want[number[x]] += p
        got = language.expected_counts([word], np.array([weight]), RANKS, prob)
        np.testing.assert_allclose(got, want / total * weight, rtol=1e-9, atol=1e-12)


def test_each_document_is_packed_whole_and_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = Tokenizer.from_file(WORDS)
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    got = packing.packed_digest(packing.pack(docs, WORDS, capacity=256)).toPandas()
    assert set(got.doc_id) == set(ids)
    for doc, own in got.sort_values("start").groupby("doc_id"):
        want, at = ids[doc], 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)


def rows_read(df):
    """Rows that the scan of a plan gave on, after what the files' metadata left out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_token_files_leave_out_rows_by_index_and_bloom_filter(spark, tmp_path):
    n = 6000
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "t.orc")
    tokens.write_token_files(docs, path, WORDS, shards=1, index_rows=1000)
    files = tokens.read_token_files(spark, path)
    plan = files.filter("doc_id = 4000")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4000)]" in plan
    assert rows_read(files) == n
    assert rows_read(files.filter("doc_id = 4000")) <= 1000  # one row group by its index
    assert rows_read(files.filter("doc_id = 4001")) == 0  # within a group's bounds, so only its Bloom filter says no
    assert [r["doc_id"] for r in files.filter("doc_id in (4000, 11998)").collect()] == [4000, 11998]


@pytest.mark.parametrize("scores, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_accuracy_on_held_out_labels(spark, scores, label):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = scores(docs, labels).toPandas().merge(labels.toPandas().groupby("doc_id").max().reset_index(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() >= 0.9
    assert (held.predicted == (held.score >= (0.3 if label == "quality" else 0.5))).all()


CONTRACTS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_recurrent_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_vptree": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_piece_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op12_merkle": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_queries_keep_their_contracts(spark, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in (x.split()[0] for x in CONTRACTS[name].split(", "))} == dict(x.split() for x in CONTRACTS[name].split(", "))
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    if name != "op8_vptree":
        found = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert set(found) == ids and (name == "op3_packing" or len(found) == len(ids))
    assert set(catalog.queries()) == set(CONTRACTS)


def test_a_column_of_many_languages_is_learned_in_part(spark):
    """Every row of a thousand has a lang of its own, beside two that are frequent."""
    rows = [(i, "the house and the garden of the man" if i % 2 else "das Haus und der Garten von dem Mann", "en" if i % 2 else "de") for i in range(200)]
    rows += [(1000 + i, f"word{i} other", f"x{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, RANKS, most_languages=3)
    assert {"de", "en"} < set(model.languages) and len(model.languages) == 3
    told = df.filter("doc_id < 200").select("lang", language.predict(model, F.col("text")).alias("p")).collect()
    assert all(r["p"]["lang_pred"] == r["lang"] for r in told)


def test_texts_are_taken_by_their_bytes():
    texts = ["x" * 3000, "y" * 3000, "z" * 10, None, "w" * 9000, "v"] * 3
    batch = pa.record_batch([pa.array(range(18)), pa.array(texts)], names=["n", "text"])
    got = list(parts(iter([batch, batch.slice(0, 0), batch]), 1, 4, 5000))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts + texts
    for p in got:
        sizes = [len(t or "") for t in p.column(1).to_pylist()]
        assert len(sizes) <= 4 and (sum(sizes) <= 5000 or len(sizes) == 1)
