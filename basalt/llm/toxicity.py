"""Toxicity: gradient-boosted trees over dense lexical features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import held, in_fold, slices, unused
from basalt.llm.labelled import labelled_sample
from basalt.llm.words import Numbered, Table, add_up

#: Words that speak to someone, in the languages of the tables.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs and digits that stand for letters inside a word.
STAND_INS = str.maketrans("013457@$!|", "oieastasil")
INSIDE = re.compile(r"(?<=\w)[^\w\s]+(?=\w)|(?<=[^\W\d_])\d+(?=[^\W\d_])|(?<=\w)[@$!|](?=\w)|_")
THRICE = re.compile(r"(.)\1{2,}")
STEMS = (4, 5, 6)
WORD_FIELDS = ("weight", "hit", "second", "letters", "upper", "shout", "signs", "bangs", "hidden", "drawn", "chars", "words")
FEATURES = (
    "hit_rate", "weight_rate", "top_weight", "hits", "distinct_hits", "second_rate", "addressed_rate", "addressed_hits",
    "capitals", "shouting", "signs", "bangs", "hidden", "drawn", "word_length", "words",
)


def plain(word: str) -> str:
    """A word as it would be written openly: lower case, stand-ins undone, signs within it and long repeats taken out."""
    w = word.lower()
    core = w.strip(".,;:!?\"'()[]{}<>|*#%&$-_~`")
    if not core.isalpha():
        core = re.sub(r"[\W_]", "", core.translate(STAND_INS))
    return THRICE.sub(r"\1", core)


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its stems (marked by a hyphen)."""
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)] if word else []


class Features:
    """Dense features of texts, given the lexicon's weights."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon

    def _word(self, word: str) -> list[float]:
        core = plain(word)
        weight = max((self.lexicon.get(e, 0.0) for e in entries(core)), default=0.0)
        letters = sum(c.isalpha() for c in word)
        upper = sum(c.isupper() for c in word)
        signs = sum(not c.isalnum() for c in word)
        hidden = letters > 0 and INSIDE.search(word) is not None
        return [weight, weight > 0, core in SECOND_PERSON, letters, upper, letters > 2 and upper == letters, signs, word.count("!"), hidden, THRICE.search(word.lower()) is not None, len(word), 1]

    def __call__(self, texts: list[str | None], cache: dict, room: int = 300_000, window: int = 5, at_once: int = 1 << 17) -> np.ndarray:
        """One row a text, in the order of FEATURES; an empty text has zeros. Fields are gathered for ``at_once`` words at a time."""
        if not cache or cache["numbers"].full(room):
            cache |= {"numbers": Numbered(), "table": Table(len(WORD_FIELDS), np.float32)}
        numbers, table = cache["numbers"], cache["table"]
        split = [(t or "").split() for t in texts]
        lens = np.array([len(x) for x in split], np.int64)
        rows = numbers.of([w for ws in split for w in ws])
        new = numbers.drain()
        if new:
            table.append(np.array([self._word(w) for w in new], np.float32))
        out, some = np.zeros((len(texts), len(FEATURES))), np.flatnonzero(lens)
        if not len(some):
            return out
        starts, n = (np.cumsum(lens) - lens)[some], lens[some]
        doc, fields = np.repeat(np.arange(len(some)), n), np.zeros((len(some), len(WORD_FIELDS)))
        add_up(fields, doc, rows, table, at_once)
        sums = dict(zip(WORD_FIELDS, fields.T))
        weight, hit, second = (table.data[:, i][rows] for i in range(3))
        hits = np.flatnonzero(hit)
        seconds = np.concatenate([[0], np.cumsum(second, dtype=np.int64)])
        first, last = starts[doc[hits]], (starts + n)[doc[hits]]
        addressed = seconds[np.minimum(hits + window + 1, last)] - seconds[np.maximum(hits - window, first)] > 0
        near = np.bincount(doc[hits], addressed, len(some))
        distinct = np.bincount(np.unique(np.stack([doc[hits], rows[hits]]), axis=1)[0].astype(int), minlength=len(some)) if len(hits) else np.zeros(len(some))
        letters, chars = np.maximum(sums["letters"], 1), np.maximum(sums["chars"], 1)
        columns = (
            sums["hit"] / n, sums["weight"] / n, np.maximum.reduceat(weight, starts), np.log1p(sums["hit"]), np.log1p(distinct), sums["second"] / n, near / n, np.log1p(near),
            sums["upper"] / letters, sums["shout"] / n, sums["signs"] / chars, sums["bangs"] / n, sums["hidden"] / n, sums["drawn"] / n, sums["chars"] / n, np.log1p(n),
        )
        out[some] = np.stack(columns, axis=1)
        return out


class Boosted:
    """Boosted trees of one depth for log loss, grown on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            node, feature, limit = np.zeros(len(y), int), np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    best = self._split(binned[node == k], (y - p)[node == k], (p * (1 - p))[node == k], edges)
                    if best:
                        feature[k], limit[k] = best
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, y - p, 2**self.depth), np.bincount(leaf, p * (1 - p), 2**self.depth)
            values = self.rate * g / (h + 1.0)
            self.forest.append((feature, limit, values))
            z += values[leaf]
        return self

    def _split(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float] | None:
        gain, best = 1e-6, None
        if not len(g):
            return None
        whole = g.sum() ** 2 / (h.sum() + 1.0)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            gs, hs, ns = (np.cumsum(np.bincount(binned[:, j], w, len(e) + 1))[:-1] for w in (g, h, np.ones(len(g))))
            value = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
            value[(ns < self.least) | (len(g) - ns < self.least)] = 0
            at = int(np.argmax(value))
            if value[at] > gain:
                gain, best = float(value[at]), (j, float(e[at]))
        return best

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, limit, values in self.forest:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
            z += values[node - (2**self.depth - 1)]
        return z


class Isotonic:
    """A non-decreasing step fit of labels on raw scores, by pooling adjacent violators; linear between its blocks."""

    def __init__(self, z: np.ndarray, y: np.ndarray) -> None:
        order, blocks = np.argsort(z, kind="stable"), []
        for zi, yi in zip(z[order], y[order]):
            blocks.append([yi, 1.0, zi, zi])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                s, n, _, hi = blocks.pop()
                blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
        self.z = np.array([e for b in blocks for e in (b[2], b[3])])
        self.p = np.array([b[0] / b[1] for b in blocks for _ in range(2)])

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.z, self.p) if len(self.z) else 1 / (1 + np.exp(-z))


class ToxicityModel:
    def __init__(self, features: Features, trees: Boosted, calibration: Isotonic) -> None:
        self.features, self.trees, self.calibration = features, trees, calibration

    def score(self, texts: list[str | None], cache: dict) -> np.ndarray:
        return self.calibration(self.trees.raw(self.features(texts, cache)))


def fit(
    df: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = 12000, lexicon: int = 400, least: int = 5, odds: float = 2.0
) -> ToxicityModel:
    """Fits on about ``sample`` labelled documents outside the held-out fold.

    Half of the sample gives the lexicon: the ``lexicon`` words and stems with the largest weight (log
    odds of the shares of toxic and of other documents that hold them, ``odds`` or more, in ``least``
    toxic documents or more); tasks count, Spark adds up. The other half, whose words had no part in
    the lexicon, gives the trees and, a third of it, the calibration.
    """
    rows = labelled_sample(df, labels, label, sample, doc_id, text).persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[y > 0].update({e for w in set(t.split()) for e in entries(plain(w))})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["entry", "a", "b"])

    half = rows.filter("part < 50")
    sizes = half.agg(F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    toxic, clean = sizes["a"], sizes["n"] - sizes["a"]
    counted = half.select("text", "y").mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weight = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    top = counted.filter(F.col("a") >= least).withColumn("w", weight).filter(F.col("w") >= odds).orderBy(F.desc(F.col("w") * F.log1p("a")), "entry").limit(lexicon)
    features = Features({r["entry"]: float(r["w"]) for r in top.collect()})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            x = features(batch.column(2).to_pylist(), cache)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "part", "x"])

    own = rows.filter("part >= 50").select("y", "part", "text").mapInArrow(measured, "y int, part long, x array<double>").toPandas()
    rows.unpersist()
    x = np.stack(own["x"].to_numpy()) if len(own) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, own["part"].to_numpy())) if len(own) else np.zeros(0, int)
    x, y, apart = x[order], (own["y"].to_numpy(float)[order] > 0).astype(float), own["part"].to_numpy()[order] >= 83
    trees = Boosted().fit(x[~apart], y[~apart])
    return ToxicityModel(features, trees, Isotonic(trees.raw(x[apart]), y[apart]))


def score(model: ToxicityModel, text: Column) -> Column:
    """The calibrated probability of label 1 for a text column; a null text counts as empty."""
    key = hash((tuple(model.features.lexicon.items()), model.trees.start, len(model.trees.forest)))

    def run(column: pa.Array) -> pa.Array:
        cache = held(("toxicity", key), dict)  # words that this worker has met
        parts = [model.score(x.to_pylist(), cache) for x in slices(column, 256)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(run, "double")(text)


def toxicity_scores(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 12000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    With no labelled row the score is 0.5 for all. A null doc_id is not held out. Repeated rows stay;
    an empty table gives none. Other columns are not read.
    """
    model = fit(df, labels, label, doc_id, text, sample)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = rows.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 12000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all their columns, that score below ``threshold``; without labels of both kinds, all rows.

    A null or empty text scores as one without words; nulls in other columns do not matter. Repeated
    rows stay or go together; an empty table gives none. Columns may have any names.
    """
    model, told = fit(df, labels, label, doc_id, text, sample), unused(df, "toxicity_told")
    if not model.trees.forest:
        return df
    return df.withColumn(told, score(model, F.col(text))).filter(F.col(told) < threshold).drop(told)
