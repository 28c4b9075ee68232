"""Language-model scores: corpus counts, a gated recurrent model trained over all shards, and whole-document likelihoods."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, held, in_fold, parts, share
from basalt.llm.gru import Adam, Gru
from basalt.llm.words import split_words

LN10 = math.log(10)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space, with A-Z in lower case: distinct ones, the number among them of each word in order, and how many each text has."""
    words, places, counts = split_words(pc.ascii_lower(pc.fill_null(texts, b"").cast(pa.string(), safe=False)))
    empty = pc.index(words, pa.scalar(b"", words.type)).as_py()
    if empty >= 0:
        there, of = places != empty, np.repeat(np.arange(len(counts)), counts)
        places, counts = places[there], np.bincount(of[there], minlength=len(counts))
        places, words = places - (places > empty), pa.concat_arrays([words[:empty], words[empty + 1 :]])
    return words, places, counts


def word_counts(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """word (binary) and n over all rows' texts: each task adds up its own first, ``most`` words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("recurrent",), object)  # nothing to keep, but what other operators left goes
        tables, size = [], 0
        for batch in _parts(batches, 0):
            words, places, _ = words_of(batch.column(0))
            tables.append(pa.table({"word": words, "n": np.bincount(places, minlength=len(words))}))
            size += len(words)
            if size > 2 * most:
                tables = [added_up(tables)]
                size = len(tables[0])
                if size > most:
                    yield from tables[0].to_batches()
                    tables, size = [], 0
        if tables:
            yield from added_up(tables).to_batches()

    def added_up(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    return rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Coder:
    """Ids of the recurrent model, and log10(c + 1), for the words that are sent to every task."""

    def __init__(self, frequent: dict[bytes, int], head: list[bytes]) -> None:
        rest = sorted(frequent.keys() - set(head))
        self.rows = {w: i for i, w in enumerate([*head, *rest])}
        self.head = len(head)
        self.logs = np.log10(np.array([frequent[w] for w in self.rows] or [0], float) + 1)

    def __call__(self, words: pa.Array) -> np.ndarray:
        """A row per word: below ``head`` those of the model, -1 for words that are not sent."""
        return np.fromiter(map(self.rows.get, words.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int32, len(words))

    def docs(self, rows: np.ndarray, counts: np.ndarray, model: Gru) -> list[np.ndarray]:
        """For the model, by document: any other word is one, and the end follows."""
        ids = np.where((rows >= 0) & (rows < self.head), rows, np.int32(model.rest))
        ids, ends = np.insert(ids, np.cumsum(counts), np.int32(model.end)), np.cumsum(counts + 1).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    return parts(batches, column, 1024, 1 << 21)


def _docs(batches: Iterator[pa.RecordBatch], coder: Coder, model: Gru) -> Iterator[np.ndarray]:
    """The model's ids of the texts in the first column, one by one."""
    for batch in _parts(batches, 0):
        words, places, counts = words_of(batch.column(0))
        yield from coder.docs(coder(words)[places], counts, model)


def _sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, so many of them each; reduceat adds in pairs, for less rounding than one by one."""
    out, some = np.zeros(len(counts)), counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def train(
    rows: DataFrame,
    frequent: dict[bytes, int],
    head: list[bytes],
    hidden: int = 24,
    sample: int = 1500,
    sample_tokens: int = 3_000_000,
    epochs: int = 4,
    rate: float = 8e-3,
    shard_rate: float = 2e-3,
    tokens: int = 1_000_000,
) -> np.ndarray:
    """The weights after a first round on about ``sample`` documents and one pass over all rows.

    The first round, in one task over ``sample_tokens`` tokens of the sample at most, brings the weights
    near a good place. Then each task goes on from there over its whole shard of the corpus, and the
    weights of all tasks are averaged by their tokens: a task sends one vector of fixed length, a few
    tasks add vectors up, and their sums come to the driver.
    """
    spark, total = rows.sparkSession.sparkContext, rows.count()
    coder = Coder({w: frequent[w] for w in head}, head)
    sent = spark.broadcast(coder)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, step, docs, n = Gru(sent.value.head, hidden=hidden), Adam(rate), [], 0
        for doc in _docs(batches, sent.value, own):
            if n < sample_tokens:
                docs.append(doc[: sample_tokens - n])
                n += len(docs[-1])
        for _ in range(epochs):
            own.train(docs, step, width=128)
        yield _sum_row(n, own.weights().astype(np.float64))

    sampled = rows.filter(share("doc_id", "recurrent", sample, total)).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), F.xxhash64("text"))
    got = sampled.select("text").mapInArrow(first, "n long, weights binary").collect()
    weights = np.frombuffer(got[0]["weights"]).astype(np.float32) if got else Gru(len(head), hidden=hidden).weights()
    begun = spark.broadcast((weights, coder))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, coder = begun.value
        own, step, n, docs, waiting = Gru(coder.head, hidden=hidden).with_weights(weights.copy()), Adam(shard_rate), 0, [], 0
        for doc in _docs(batches, coder, own):
            docs.append(doc)
            waiting += len(docs[-1])
            if waiting >= tokens:
                n += own.train(docs, step)
                docs, waiting = [], 0
        n += own.train(docs, step)
        if n:
            yield _sum_row(n, own.weights().astype(np.float64) * n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, total = n + k, np.frombuffer(w) + (0 if total is None else total)
        if n:
            yield _sum_row(n, total)

    shards = rows.select("text").mapInArrow(shard, "n long, weights binary")
    few = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    sums = shards.repartition(few).mapInArrow(add, "n long, weights binary").collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return weights
    return (sum(np.frombuffer(r["weights"]) for r in sums) / n).astype(np.float32)


def _sum_row(n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


def lm_scores(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    hidden: int = 24,
    head_words: int | None = None,
    common: int = 1_000_000,
    tokens: int = 1_000_000,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words and one end. Counts c of all N training tokens, V distinct ones, give the
    base: the sum of log10((c + 1) / (N + V + 1)). The score adds, token by token, the recurrent
    model's log10 probability of the token's class and, in the classes of the most frequent words, of
    the word; any other word has its share (c + 1) of the class of all other words, where unseen words
    together count as one, so that the score is a probability over the same tokens as the base.

    The model has ``hidden`` units and the ``head_words`` most frequent words of the training rows; unless
    given, the square root of the number of distinct ones, 1,024 at least, so that the head grows with
    the corpus. Head words are dealt to as many classes as a class has words.

    Words that make up at least one in ``common`` training tokens (so at most that many words) are sent
    to every task with their counts; counts of all others are found by a join. A null text is empty: its
    end only. A null doc_id is neither trained on nor held out. Repeated rows stay; an empty table gives
    no rows, and one without training rows has N = V = 0. Other columns are not read.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), in_fold(doc_id, folds, held_fold).alias("held_out"))
    training = rows.filter("doc_id is not null and not held_out").select("doc_id", "text")
    counts = cut(word_counts(training))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = training.count()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    frequent = {bytes(r["word"]): r["n"] for r in counts.filter(F.col("n") * common >= n).collect()}
    head = sorted(frequent, key=lambda w: (-frequent[w], w))[: head_words or max(1024, math.isqrt(sums["v"]))]
    rest = sums["n"] - sum(frequent[w] for w in head) + (sums["v"] - len(head)) + 1
    weights = train(training, frequent, head, hidden)
    spark = df.sparkSession.sparkContext
    shared = spark.broadcast((Coder(frequent, head), weights))
    log_end, one = math.log10(ends + 1), math.log10(n + v + 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, weights = shared.value
        model = Gru(coder.head, hidden=hidden).with_weights(weights)
        out, docs, waiting = [], [], 0
        for batch in _parts(batches, 3):
            words, places, counts = words_of(batch.column(3))
            at, of, size = coder(words)[places], np.repeat(np.arange(len(counts)), counts), len(counts)
            own = coder.docs(at, counts, model)
            docs += own
            waiting += len(at) + size
            sent, far = at >= 0, at >= coder.head
            seen, sum_log = np.bincount(of[sent], minlength=size), _sums_of(np.where(sent, coder.logs[at], 0), counts)
            far_log, outside = _sums_of(np.where(far, coder.logs[at], 0), counts), np.bincount(of[far], minlength=size) + counts - seen
            pairs, k = np.unique(of[~sent] * np.int64(max(1, len(words))) + places[~sent], return_counts=True)
            of_pair, word = np.divmod(pairs, max(1, len(words)))
            ends = np.cumsum(np.bincount(of_pair, minlength=size))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(k, pa.int64())], names=["word", "k"]))
            columns = [*batch.columns[:3], *map(pa.array, (counts + 1, seen, sum_log, far_log, outside)), rare]
            out.append(pa.record_batch(columns, names=["row_id", "doc_id", "held_out", "n_tokens", "seen", "sum_log", "model_log", "outside", "rare"]))
            if waiting >= tokens:
                yield from scored(out, model.log_probabilities(docs))
                out, docs, waiting = [], [], 0
        if out:
            yield from scored(out, model.log_probabilities(docs))

    def scored(out: list[pa.RecordBatch], logs: list[float]) -> Iterator[pa.RecordBatch]:
        """The batches, with the model's logarithms added to those of the words that it doesn't know."""
        logs, at = np.array(logs) / LN10, 0
        for batch in out:
            yield batch.set_column(6, "model_log", pa.array(batch.column(6).to_numpy() + logs[at : at + len(batch)]))
            at += len(batch)

    numbered = rows.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "held_out", "text")
    numbered = numbered.withColumn("doc_id", F.col("doc_id").cast("long"))
    fields = "row_id long, doc_id long, held_out boolean, n_tokens long, seen long, sum_log double, model_log double, outside long, rare array<struct<word: binary, k: long>>"
    found = cut(numbered.mapInArrow(local, fields))
    rare = found.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.k")
    joined = rare.join(counts.filter(F.col("n") * common < n), "word")
    more = joined.groupBy("row_id").agg(F.sum("k").alias("more_seen"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_log"))
    zero = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    return found.drop("rare").join(more, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + zero("more_seen", 0) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum_log") + zero("more_log", 0.0) + F.lit(log_end) - F.col("n_tokens") * F.lit(one)).alias("base_score"),
        (F.col("model_log") + zero("more_log", 0.0) - F.col("outside") * F.lit(math.log10(rest))).alias("score"),
    )
