"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import held, in_fold, slices
from basalt.llm.labelled import labelled_sample
from basalt.llm.words import Numbered, Ragged, Table, add_up

UNIT = re.compile(r"[^\W\d_]+|\d+|[\W_]+")


class Index:
    """Words as buckets of a table of fixed size, and each bucket's sparse random index vector."""

    def __init__(self, buckets: int = 1 << 15, width: int = 32, ones: int = 4, seed: int = 11) -> None:
        self.buckets, self.width = buckets, width
        rng = np.random.default_rng(seed)
        self.vectors = np.zeros((buckets, width), np.float32)
        places = rng.integers(0, width, (buckets, ones))
        np.add.at(self.vectors, (np.arange(buckets)[:, None], places), rng.choice([-1.0, 1.0], (buckets, ones)).astype(np.float32))
        self.repeat = self.bucket("shape", "repeat")

    def bucket(self, kind: str, value: str) -> int:
        return zlib.crc32(f"{kind}:{value}".encode()) % self.buckets

    def of_word(self, word: str) -> list[int]:
        """Of one word between spaces: its letters in lower case, its shape, and its other signs."""
        out = []
        for unit in UNIT.findall(word):
            if unit[0].isalpha():
                shape = "upper" if unit.isupper() and len(unit) > 1 else "lower" if unit.islower() else "title" if unit.istitle() else "mixed"
                out += [self.bucket("word", unit.lower()), self.bucket("shape", shape)]
            else:
                out.append(self.bucket("digits", "") if unit[0].isdigit() else self.bucket("signs", unit))
        return out


def context_sums(texts: list[str], index: Index, window: int = 2, at_once: int = 1 << 17) -> np.ndarray:
    """For each bucket the sum of the index vectors found within ``window`` places of it; the last column counts it.

    Vectors are gathered for ``at_once`` places at a time, however long a text is.
    """
    out = np.zeros((index.buckets, index.width + 1))
    numbers, ids = Numbered(), Ragged()
    for text in texts:
        rows = numbers.of((text or "").split())
        new = [index.of_word(w) for w in numbers.drain()]
        ids.append(np.array([b for x in new for b in x], np.int32), np.array([len(x) for x in new], np.int64))
        seq, _ = ids.take(rows)
        for a in range(0, len(seq), at_once):
            lo, b = max(0, a - window), min(a + at_once, len(seq))
            own = index.vectors[seq[lo : b + window]]
            near = np.zeros_like(own)
            for k in range(1, min(window, len(own) - 1) + 1):
                near[k:] += own[:-k]
                near[:-k] += own[k:]
            near, here = near[a - lo : b - lo], seq[a:b]
            order = np.argsort(here, kind="stable")
            first = np.flatnonzero(np.diff(here[order], prepend=-1))
            out[here[order][first], :-1] += np.add.reduceat(near[order], first, axis=0)
            out[:, -1] += np.bincount(here, minlength=index.buckets)
    return out


class Pooler:
    """Mean of the word vectors of a whole text: the learned context vector of each bucket beside its index vector."""

    def __init__(self, index: Index, sums: np.ndarray) -> None:
        self.index = index
        norm = np.linalg.norm(sums[:, :-1], axis=1, keepdims=True)
        self.vectors = np.concatenate([sums[:, :-1] / np.maximum(norm, 1e-9), index.vectors], axis=1).astype(np.float32)
        self.width = self.vectors.shape[1] + 1

    def features(self, texts: list[str | None], cache: dict, room: int = 300_000, at_once: int = 1 << 17) -> np.ndarray:
        """One row a text; an empty text has zeros. Vectors are gathered for ``at_once`` words at a time."""
        if not cache or cache["numbers"].full(room):
            cache |= {"numbers": Numbered(), "table": Table(self.width, np.float32)}
        numbers, table = cache["numbers"], cache["table"]
        split = [(t or "").split() for t in texts]
        lens = np.array([len(x) for x in split], np.int64)
        rows = numbers.of([w for ws in split for w in ws])
        new = [self.index.of_word(w) for w in numbers.drain()]
        if new:
            counts = np.array([len(x) for x in new])
            summed = np.add.reduceat(self.vectors[[b for x in new for b in x]], np.cumsum(counts) - counts, axis=0)
            table.append(np.concatenate([summed, counts[:, None].astype(np.float32)], axis=1))
        out, some = np.zeros((len(texts), self.width)), np.flatnonzero(lens)
        if len(some):
            starts = np.cumsum(lens) - lens
            add_up(out, np.repeat(np.arange(len(texts)), lens), rows, table, at_once)
            again = np.concatenate([[0], rows[1:] == rows[:-1]])
            again[starts[some]] = 0
            repeats = np.add.reduceat(again, starts[some])
            out[some, :-1] += repeats[:, None] * self.vectors[self.index.repeat]
            out[some, :-1] /= out[some, -1:]
            out[:, -1] = np.log1p(out[:, -1])
        return out


class Network:
    """Two layers, trained by Adam on standardised features, with a temperature set on rows apart."""

    def __init__(self, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> None:
        self.hidden, self.epochs, self.batch, self.rate, self.decay, self.seed = hidden, epochs, batch, rate, decay, seed
        self.temperature, self.constant = 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> Network:
        """``apart``: which rows are kept from training, to set the temperature."""
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        rng, train = np.random.default_rng(self.seed), ~apart if (~apart).any() else apart
        self.mean, self.sd = x[train].mean(0), x[train].std(0) + 1e-6
        x = (x - self.mean) / self.sd
        n = x.shape[1]
        w = [rng.normal(0, 1 / np.sqrt(n), (n, self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        rows = np.flatnonzero(train)
        for _ in range(self.epochs):
            for part in np.array_split(rng.permutation(rows), max(1, len(rows) // self.batch)):
                a = np.tanh(x[part] @ w[0] + w[1])
                g = (_sigmoid(a @ w[2] + w[3]) - y[part]) / len(part)
                back = g[:, None] * w[2] * (1 - a * a)
                grads = [x[part].T @ back + self.decay * w[0], back.sum(0), a.T @ g + self.decay * w[2], g.sum(keepdims=True)]
                step += 1
                for i, d in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    w[i] -= self.rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        check = apart if apart.any() else train
        z, own = self._logit(x[check]), y[check]
        scales = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        losses = [np.mean(np.logaddexp(0, z / t) - own * z / t) for t in scales]
        self.temperature = float(scales[int(np.argmin(losses))])
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self._logit((x - self.mean) / self.sd) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class QualityModel:
    def __init__(self, pooler: Pooler, network: Network) -> None:
        self.pooler, self.network = pooler, network


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = 6000) -> QualityModel:
    """Fits on about ``sample`` labelled documents outside the held-out fold.

    Tasks add up the context vectors of the sample's words (a table of fixed size), then pool the
    sample's documents; the network sees only the pooled vectors. A fifth of the sample sets the temperature.
    """
    rows, index = labelled_sample(df, labels, label, sample, doc_id, text).persist(), Index()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((index.buckets, index.width + 1))
        for batch in batches:
            sums += context_sums(batch.column(0).to_pylist(), index)
        some = np.flatnonzero(sums[:, -1])
        yield pa.record_batch([pa.array(some)] + [pa.array(sums[some, i]) for i in range(index.width + 1)], names=["bucket", *(f"v{i}" for i in range(index.width + 1))])

    columns = [f"v{i}" for i in range(index.width + 1)]
    got = rows.select("text").mapInArrow(contexts, "bucket long, " + ", ".join(f"{c} double" for c in columns)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    sums = np.zeros((index.buckets, index.width + 1))
    sums[got["bucket"]] = got[columns].to_numpy()
    pooler = Pooler(index, sums)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            x = pooler.features(batch.column(2).to_pylist(), cache)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "part", "x"])

    own = rows.select("y", "part", "text", "doc_id").mapInArrow(pooled, "y int, part long, x array<double>").toPandas()
    rows.unpersist()
    x = np.stack(own["x"].to_numpy()) if len(own) else np.zeros((0, pooler.width))
    order = np.lexsort((*x.T[:3], own["part"].to_numpy())) if len(own) else np.zeros(0, int)
    x, y, part = x[order], own["y"].to_numpy(float)[order], own["part"].to_numpy()[order]
    return QualityModel(pooler, Network().fit(x, (y > 0).astype(float), part >= 80))


def score(model: QualityModel, text: Column) -> Column:
    """The calibrated probability of label 1 for a text column; a null text counts as empty."""
    key = hash((model.pooler.vectors.tobytes(), model.network.temperature))

    def run(column: pa.Array) -> pa.Array:
        cache = held(("quality", key), dict)  # words that this worker has met
        parts = [model.network.score(model.pooler.features(x.to_pylist(), cache)) for x in slices(column, 256)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")(text)


def quality_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    With no labelled row the score is 0.5 for all; with one label only, that label. A null doc_id is
    not held out. Repeated rows stay; an empty table gives none. Other columns are not read.
    """
    model = fit(df, labels, label, doc_id, text, sample)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = rows.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
