"""Packing of token ids into windows by minimum bin slack over a histogram of piece lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import cut, texts
from basalt.llm.common import parts as in_parts
from basalt.llm.words import word_encoder


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest not above ``room``.

    Bit s of ``reach`` says that the sum s can be had. Counts are added in powers of two; the steps are
    kept, and going back through them gives how many pieces of each length make the best sum.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, 2 * k
    best, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + k
            best -= length * k
    return chosen


class Plan:
    """Where the r-th piece of each length goes, for all r.

    Rows are segments of the ranks of one length: from rank ``first`` on, each ``per`` pieces fill one
    sequence from ``base`` on, at ``offset``; or, if ``head`` is not 0, each piece is cut there, the
    head goes to a sequence at ``offset``, and the rest is a piece of its own of rank ``rest`` on.
    A histogram has at most ``capacity`` lengths, and each pattern of a sequence is repeated as often
    as the counts allow, so the plan does not grow with the number of documents.
    """

    FIELDS = ("length", "first", "per", "base", "offset", "head", "rest")

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.rows: list[tuple[int, ...]] = []
        self.left = {x: n for x, n in histogram.items() if n}
        self.total, self.next, self.sequences = dict(self.left), dict.fromkeys(self.left, 0), 0
        tokens = sum(x * n for x, n in self.left.items())
        while tokens:
            # The last tokens, too few for a window, go to sequences of powers of two, which need no padding.
            window = capacity if tokens >= capacity else 1 << (tokens.bit_length() - 1)
            tokens -= window * self._pattern(window)
        self.segments = {f: np.array([r[i] for r in sorted(self.rows)], np.int64) for i, f in enumerate(self.FIELDS)}

    def _pattern(self, window: int) -> int:
        """One pattern of a full sequence, as many times as it can be had."""
        largest, others = max(self.left), dict(self.left)
        need = {largest: 1} if largest <= window else {}
        for x in need:
            others[x] -= 1
        for x, k in fill({x: n for x, n in others.items() if n}, window - sum(need)).items():
            need[x] = need.get(x, 0) + k
        slack, cut_from = window - sum(x * k for x, k in need.items()), 0
        if slack:  # no whole piece fits in, so one that is longer is cut
            spare = {x: n - need.get(x, 0) for x, n in self.left.items() if x > slack and n > need.get(x, 0)}
            cut_from = max(spare, key=lambda x: (spare[x], x))
        uses = dict(need)
        if cut_from:
            uses[cut_from] = uses.get(cut_from, 0) + 1
        times = min(self.left[x] // k for x, k in uses.items())
        offset = 0
        for x in sorted(need, reverse=True):
            self._add(x, need[x], times, offset)
            offset += x * need[x]
        if cut_from:
            self._cut(cut_from, slack, times, offset)
        self.sequences += times
        return times

    def _take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
        return first

    def _add(self, length: int, per: int, times: int, offset: int) -> None:
        self.rows.append((length, self._take(length, per * times), per, self.sequences, offset, 0, 0))

    def _cut(self, length: int, head: int, times: int, offset: int) -> None:
        first, rest = self._take(length, times), length - head
        self.rows.append((length, first, 1, self.sequences, offset, head, self.total.get(rest, 0)))
        self.total[rest] = self.total.get(rest, 0) + times
        self.left[rest] = self.left.get(rest, 0) + times
        self.next.setdefault(rest, 0)

    def place(self, length: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
        """Pieces of those lengths and ranks: piece (its row), start in the piece, length, sequence, offset."""
        s = self.segments
        keys, piece = s["length"] << 44 | s["first"], np.arange(len(length))
        start, out = np.zeros(len(length), np.int64), []
        while len(piece):
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            n, head, per = rank - s["first"][at], s["head"][at], s["per"][at]
            whole = head == 0
            out.append((piece, start, np.where(whole, length, head), s["base"][at] + n // per, s["offset"][at] + np.where(whole, n % per * length, 0)))
            more = ~whole
            piece, start, rank = piece[more], start[more] + head[more], (s["rest"][at] + n)[more]
            length = (length - head)[more]
        fields = ("piece", "start", "length", "sequence_id", "offset")
        joined = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return dict(zip(fields, joined))


def pack(
    df: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is the end id alone. Documents are cut at
    each ``capacity`` ids. The counts of the pieces' lengths (at most ``capacity`` numbers) go to the
    driver, which plans sequences by minimum bin slack; where no set of whole pieces fills a window, one
    piece is cut. Pieces get ranks within their length in buckets of bounded size, and each finds its
    place in the plan by length and rank. An empty table gives no rows; repeated rows are packed each;
    null doc_ids are kept. Other columns are not read.
    """
    rows = texts(df, doc_id, text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        kind = "<u2" if max(encoder.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in in_parts(batches, 1, 256):
            flat, lens = encoder(batch.column(1).to_pylist())
            flat, lens = np.insert(flat, np.cumsum(lens), end_id).astype(kind), lens + 1
            parts = -(-lens // capacity)
            doc = np.repeat(np.arange(len(lens)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, lens[doc] - start)
            first = (np.cumsum(lens) - lens)[doc] + start
            ids = [flat[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist())]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(lens[doc]), pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    # Numbers of the pieces deal them to buckets, since null and repeated ids would meet in one.
    cut_up = cut(rows.mapInArrow(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary").withColumn("piece", F.monotonically_increasing_id()))
    total = cut_up.count()
    # A third of all pieces may have one length; a bucket of a length stays at some thousands of pieces.
    buckets = max(64, total // 20_000)
    bucketed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    counts = cut(bucketed.groupBy("length", "bucket").count())
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    plan = df.sparkSession.sparkContext.broadcast(Plan(histogram, capacity))
    before = counts.selectExpr(
        "length", "bucket", "coalesce(sum(count) over (partition by length order by bucket rows between unbounded preceding and 1 preceding), 0L) as before"
    )
    ranked = bucketed.withColumn("n", F.expr("row_number() over (partition by length, bucket order by doc_id, start, piece) - 1L")).join(before, ["length", "bucket"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length, tokens, ids, rank = batch.columns
            to = plan.value.place(length.to_numpy(), rank.to_numpy())
            row = pa.array(to["piece"])
            own = ids.to_pylist()
            size = (np.array([len(x) for x in own]) // np.maximum(length.to_numpy(), 1)).tolist()
            out = [np.frombuffer(own[i], f"<u{size[i]}")[a : a + n].astype("<u4").tobytes() for i, a, n in zip(to["piece"].tolist(), to["start"].tolist(), to["length"].tolist())]
            yield pa.record_batch(
                [doc.take(row), pa.array(start.to_numpy()[to["piece"]] + to["start"]), pa.array(to["length"]), pa.array(out, pa.binary()), tokens.take(row), pa.array(to["sequence_id"]), pa.array(to["offset"])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("before") + F.col("n")).alias("rank")).mapInArrow(
        place, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
