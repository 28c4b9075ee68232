"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

import base64
import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import held, in_fold, slices, unused
from basalt.llm.words import Numbered, Table

LETTERS = re.compile(r"[^\W\d_]+")
#: Ends of a word that are looked up at once, and (words x bytes) of a batch.
BLOCK, BATCH = 1 << 14, 200_000


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The public vocabulary: byte strings of a rank file. All single bytes are in it, so any text has a segmentation."""
    with open(path, "rb") as lines:
        found = {base64.b64decode(line.split()[0]) for line in lines}
    return sorted(found | {bytes([b]) for b in range(256)})


@functools.lru_cache(maxsize=2)
def _tables(path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per piece length, up to the longest piece that a word can hold: the sorted pieces as keys, and their numbers.

    Up to eight bytes make one integer; longer pieces are compared as byte strings.
    """
    own = [(x, i) for i, x in enumerate(pieces(path)) if _in_words(x)]
    out = []
    for n in range(1, max(len(x) for x, _ in own) + 1):
        some = [(x, i) for x, i in own if len(x) == n]  # pieces() sorts them
        keys = np.array([int.from_bytes(x, "big") for x, _ in some], np.uint64) if n <= 8 else np.array([x for x, _ in some], f"S{n}")
        out.append((keys, np.array([i for _, i in some], np.int32)))
    return out


def _in_words(piece: bytes) -> bool:
    """Whether a piece can stand in a word, which has no space but the one that it begins with, nor any other ASCII sign than letters."""
    return not any(b < 97 or 122 < b < 128 for b in piece[piece[:1] == b" " :])


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case; runs of numerals alone (as fractions and superscripts) are none."""
    return [w for w in LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def batches_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length together: their places in the list, and their bytes as a matrix. A word begins with a space."""
    coded = [b" " + w.encode() for w in words]
    lens = np.array([len(w) for w in coded])
    for size in np.unique(lens):
        rows = np.flatnonzero(lens == size)
        for part in np.array_split(rows, max(1, len(rows) * int(size) // BATCH)):
            if len(part):
                yield part, np.frombuffer(b"".join(coded[i] for i in part), np.uint8).reshape(len(part), size)


def lattice(chars: np.ndarray, first: int, last: int, path: str) -> np.ndarray:
    """ids[i, e, n - 1]: the number of the piece of n bytes of word i that ends at first + e, or -1; ends ``first`` up to ``last``."""
    tables = _tables(path)
    reach = min(last, len(tables))
    ids = np.full((len(chars), last - first + 1, reach), -1, np.int32)
    for n, (keys, numbers) in enumerate(tables[:reach], 1):
        low = max(first, n)  # no piece of n bytes ends before
        if low > last or not len(keys):
            continue
        seen = np.lib.stride_tricks.sliding_window_view(chars[:, low - n : last], n, axis=1)
        if n <= 8:
            key = np.zeros(seen.shape[:2], np.uint64)
            for j in range(n):
                key = key << np.uint64(8) | seen[:, :, j]
        else:
            key = np.ascontiguousarray(seen).view(f"S{n}")[:, :, 0]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ids[:, low - first :, n - 1] = np.where(keys[at] == key, numbers[at], -1)
    return ids


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over axis 1; some term is finite, since each single byte is a piece."""
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def forward(chars: np.ndarray, path: str, log_prob: np.ndarray, whole: bool = False) -> np.ndarray:
    """Log of the sum over all segmentations of each word, words x languages; with ``whole``, up to each end: words x ends x languages.

    log_prob: (pieces + 1) x languages, the last row minus infinity, for a piece that isn't there. A
    word of any length is taken in blocks; only the ends that a piece can reach back to are kept.
    """
    (n, size), longest = chars.shape, len(_tables(path))
    alpha = np.full((n, 1, log_prob.shape[1]), 0.0)
    kept = [alpha]
    for first in range(1, size + 1, BLOCK):
        last = min(size, first + BLOCK - 1)
        ids = lattice(chars, first, last, path)
        back = alpha.shape[1]
        alpha = np.concatenate([alpha, np.empty((n, last - first + 1, alpha.shape[2]))], axis=1)
        for e in range(last - first + 1):
            reach = min(first + e, ids.shape[2])
            alpha[:, back + e] = _log_sum(alpha[:, back + e - reach : back + e][:, ::-1] + log_prob[ids[:, e, :reach]])
        if whole:
            kept.append(alpha[:, back:])
        alpha = alpha[:, -longest:]
    return np.concatenate(kept, axis=1) if whole else alpha[:, -1]


def word_scores(words: list[str], path: str, prob: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each language."""
    out = np.zeros((len(words), prob.shape[1]))
    with np.errstate(divide="ignore"):
        log_prob = np.log(prob)
    for rows, chars in batches_of(words):
        out[rows] = forward(chars, path, log_prob)
    return out


def expected_counts(words: list[str], weights: np.ndarray, path: str, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in all segmentations of the words, by a forward and a backward pass; one language."""
    out = np.zeros(len(prob))
    with np.errstate(divide="ignore"):
        log_prob = np.log(prob)
    for rows, chars in batches_of(words):
        size = chars.shape[1]
        alpha = forward(chars, path, log_prob, whole=True)[:, :, 0]
        beta = np.full_like(alpha, -np.inf)
        beta[:, size] = 0
        for first in range((size - 1) // BLOCK * BLOCK + 1, 0, -BLOCK):
            last = min(size, first + BLOCK - 1)
            ids = lattice(chars, first, last, path)
            for end in range(last, first - 1, -1):
                own = ids[:, end - first, : min(end, ids.shape[2])]
                onward = log_prob[own, 0] + beta[:, [end]]
                before = slice(end - own.shape[1], end)
                beta[:, before] = np.logaddexp(beta[:, before], onward[:, ::-1])
                uses = np.exp(alpha[:, before][:, ::-1] + onward - alpha[:, [size]]) * weights[rows, None]
                out += np.bincount((own % len(prob)).ravel(), uses.ravel(), len(prob))
    out[-1] = 0
    return out


class LanguageModel:
    """Languages, and the probability of each piece in each."""

    def __init__(self, languages: list[str], prob: np.ndarray, path: str) -> None:
        self.languages, self.prob, self.path = languages, prob, path


def fit(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1500, rounds: int = 2, added: float = 0.05, folds: int = 4, held: int = 2, most_languages: int = 200) -> LanguageModel:
    """Learns from text and non-null lang of rows outside the held-out fold.

    ``sample`` documents of each language, about, chosen by a hash of the id, are enough and bound the
    work, and the ``most_languages`` most frequent values of lang (ties by name), which bound the model: rarer
    values, as of a column that holds other things too, are not learned and never predicted. The words of the sample are counted by language; then ``rounds`` of expectation maximisation run over the
    counted words, from equal probabilities: tasks send the expected counts of pieces, summed by Spark,
    and only (languages x vocabulary) numbers come to the driver. With no labelled row the model knows
    no language.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold("doc_id", folds, held))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    known = pieces(path)
    if not languages:
        return LanguageModel([], np.zeros((len(known) + 1, 0)), path)
    # One row a language, so ``most_languages`` at most.
    wanted = rows.sparkSession.createDataFrame([(x, min(1.0, sample / sizes[x])) for x in languages], "lang string, wanted double")
    chosen = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.floor(F.col("wanted") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update((own, w) for w in words_of(t))
        yield pa.record_batch([pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)] + [pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    words = rows.join(F.broadcast(wanted), "lang").filter(chosen).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    prob = np.full((len(known) + 1, len(languages)), 1 / len(known))
    prob[-1] = 0
    for _ in range(rounds):
        now = prob

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(now)
            for batch in batches:
                own, w, n = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, x in enumerate(languages):
                    at = np.flatnonzero(own == x)
                    if len(at):
                        sums[:, k] += expected_counts([w[i] for i in at], n[at].astype(float), path, now[:, [k]])
            piece, language = np.nonzero(sums)
            yield pa.record_batch([pa.array(piece), pa.array(language), pa.array(sums[piece, language])], names=["piece", "language", "n"])

        got = words.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros_like(prob)
        sums[got["piece"], got["language"]] = got["n"]
        prob = (sums + added) / (sums.sum(0) + added * len(known))
        prob[-1] = 0
    words.unpersist()
    return LanguageModel(languages, prob, path)


def predict(model: LanguageModel, text: Column, room: int = 300_000) -> Column:
    """A struct of lang_pred and score for a text column.

    The score is the posterior probability, languages being equally likely beforehand, over the letters
    of the whole text. A text that is null or has no letter gets ``und`` and 0, and so does every text
    if the model knows no language. Ties go to the language that comes first in the alphabet.
    """
    key = hash((model.prob.tobytes(), tuple(model.languages)))

    def run(column: pa.Array) -> pa.Array:
        labels, scores, langs = [], [], len(model.languages)
        cache = held(("language", key), dict)  # words that this worker has scored
        for some in slices(column, 256):
            if not cache or cache["numbers"].full(room):
                cache |= {"numbers": Numbered(), "table": Table(langs)}
            numbers, table = cache["numbers"], cache["table"]
            split = [words_of(t) for t in some.to_pylist()]
            rows = numbers.of([w for ws in split for w in ws])
            table.append(word_scores(numbers.drain(), model.path, model.prob))
            own = table.data[rows]
            ends = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
            sums = np.concatenate([np.zeros((1, langs)), np.cumsum(own, 0)])
            for i, ws in enumerate(split):
                if not ws or not langs:
                    labels.append("und")
                    scores.append(0.0)
                    continue
                z = sums[ends[i + 1]] - sums[ends[i]]
                p = np.exp(z - z.max())
                k = int(np.argmax(z))
                labels.append(model.languages[k])
                scores.append(float(p[k] / p.sum()))
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(run, "lang_pred string, score double")(text)


def identify(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row: learned from one part of the rows, applied to all.

    A null doc_id is neither learned from nor held out. Repeated rows stay, and score alike; an empty
    table gives none. Other columns are not read. Runs of letters of any length are scored whole.
    """
    model = fit(df, path, doc_id, text, lang, sample)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), predict(model, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def languages_known(df: DataFrame, path: str, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1500) -> DataFrame:
    """The rows of ``df``, with all their columns, whose language is told: not ``und``, and with a score of ``least`` or more.

    Null texts and texts without a letter go, and so do all rows if no row has a language to learn from;
    a null in another column does not matter. Repeated rows stay or go together; an empty table gives
    none. Columns may have any names.
    """
    model, told = fit(df, path, doc_id, text, lang, sample), unused(df, "language_told")
    return df.withColumn(told, predict(model, F.col(text))).filter((F.col(f"{told}.lang_pred") != "und") & (F.col(f"{told}.score") >= least)).drop(told)
