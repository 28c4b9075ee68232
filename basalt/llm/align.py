"""Alignment of two tokenizers: tokens that end together, counted over the corpus, each distinct text read once."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.bpe import WHITE
from basalt.llm.common import cut, held, joined_evenly, shared_folder, slices, texts
from basalt.llm.pieces import SPACE, PieceEncoder
from basalt.llm.words import Numbered, Ragged

#: A pair of ids as one number: the first tokenizer's id above these bits.
BITS = 32


class Aligner:
    """Groups and links of texts, by units that both tokenizers cut apart; each distinct unit is aligned once and remembered.

    A unit begins with white space that follows another character, where the byte-level tokenizer always
    parts a text, and where no piece of the other one goes on.
    """

    def __init__(self, byte_path: str, piece_path: str, room: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.first, self.second, self.room = Tokenizer.from_file(byte_path), PieceEncoder(piece_path), room
        self.first.encode_special_tokens = True
        # Byte-level entries are spelt in letters that stand for bytes: those that can be printed for themselves, the rest from U+0100 on.
        printed = [b for b in range(256) if chr(b) in set(ByteLevel.alphabet())]
        byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
        self.a_bytes = [b""] * self.first.get_vocab_size()
        for token, i in self.first.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        v = self.second.vocabulary
        self.b_bytes = [bytes([i - v.bytes_from]) if v.library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), np.uint8) for t in (self.a_bytes, self.b_bytes))
        # How an id is spelt, by what follows it: a further id of its tokenizer in the group, the other tokenizer's or the next group, or nothing.
        self.spelt = [f"{i}{end}" for n, ends in ((len(self.a_len), ",|"), (len(self.b_len), (",", ";", ""))) for end in ends for i in range(n)]

        later = {b for p in v.number for a, b in zip(p, p[1:]) if not a == b == SPACE}
        stays = "".join(re.escape(c) for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c) and (SPACE if c == " " else c) in later)
        more = f"(?:[{stays}][{WHITE}]*[^{WHITE}]*)*" if stays else ""
        self.pattern = re.compile(f"[{WHITE}]+[^{WHITE}]*{more}") if v.parts_at_spaces else re.compile("(?s).+")
        self.forget()

    def forget(self) -> None:
        self.units, self.a, self.b, self.groups = Numbered(), Ragged(), Ragged(), []
        self.met = np.zeros(1 << 12, np.int64)  # how often each unit was met
        self.counts = np.zeros((0, 3), np.int64)  # tokens of either tokenizer, and 1 if the bytes are the unit's

    def make_room(self) -> None:
        """Forgets units that were met once since the last time; all of them, if the rest is still large."""
        kept = np.flatnonzero(self.met[: len(self.units)] > 1)
        if 2 * len(kept) > self.room:
            return self.forget()
        units, a, b, groups, counts = self.units, self.a, self.b, self.groups, self.counts
        names = list(units)
        self.forget()
        self.units.of([names[i] for i in kept.tolist()])
        self.units.drain()
        self.a.append(*a.take(kept))
        self.b.append(*b.take(kept))
        self.groups, self.counts = [groups[i] for i in kept.tolist()], counts[kept]

    def rows(self, units: list[str]) -> np.ndarray:
        found = self.units.of(units)
        new = self.units.drain()
        if new:
            self._learn(new)
            if len(self.units) > len(self.met):
                self.met = np.concatenate([self.met, np.zeros(max(len(self.units), 2 * len(self.met)) - len(self.met), np.int64)])
        np.add.at(self.met, found, 1)
        return found

    def _learn(self, units: list[str]) -> None:
        encoded = [x.ids for x in self.first.encode_batch_fast(units, add_special_tokens=False)]
        a = np.fromiter(itertools.chain.from_iterable(encoded), np.int64)
        a_of = np.repeat(np.arange(len(units)), [len(x) for x in encoded])
        own = [self.second.pattern.findall(u.replace(" ", SPACE)) for u in units]
        b, lens = self.second.encoded([x for parts in own for x in parts])
        b_of = np.repeat(np.repeat(np.arange(len(units)), [len(x) for x in own]), lens)
        n_a, n_b = (np.bincount(x, minlength=len(units)) for x in (a_of, b_of))

        whole = "".join(units).encode()
        size = np.array([len(u.encode()) for u in units], np.int64)
        same = np.ones(len(units), bool)
        for ids, of, lens, flat, table in ((a, a_of, self.a_len, self.a_flat, self.a_bytes), (b, b_of, self.b_len, self.b_flat, self.b_bytes)):
            if _gathered(flat, lens, ids).tobytes() != whole or (np.bincount(of, lens[ids], len(units)) != size).any():
                same &= [x == u.encode() for x, u in zip(_joined(table, ids, np.bincount(of, minlength=len(units))), units)]
        a, a_of, b, b_of = a[same[a_of]], a_of[same[a_of]], b[same[b_of]], b_of[same[b_of]]
        # Units stand one behind another with as many bytes in both, so their borders are ends in both.
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        links = np.bincount(a_of[a_cut], minlength=len(units))
        self.a.append(a[a_cut].astype(np.int32), links)
        self.b.append(b[b_cut].astype(np.int32), links)
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, same], axis=1)])

        # The spelling of a unit: group by group the first tokenizer's ids and then the second's.
        last = np.append(np.flatnonzero(np.diff(b_of)), len(b_of) - 1)  # the last token of each unit
        after_b = b_cut.astype(np.int64)
        after_b[last if len(b_of) else []] = 2
        token = np.concatenate([a + a_cut * len(self.a_len), 2 * len(self.a_len) + b + after_b * len(self.b_len)])
        group = np.concatenate([2 * (np.cumsum(a_cut) - a_cut), 2 * (np.cumsum(b_cut) - b_cut) + 1])
        each = map(self.spelt.__getitem__, token[np.argsort(group, kind="stable")].tolist())
        self.groups += ["".join(itertools.islice(each, n)) for n in np.where(same, n_a + n_b, 0).tolist()]

    def of(self, text: str, most: int = 1 << 17) -> tuple[int, int, str, np.ndarray]:
        """n_a, n_b, the digest of the groups and the pairs of all links of a text; nothing if the tokens are not its bytes."""
        found, digest, n, pairs, begun = (m[0] for m in self.pattern.finditer(" " + text)), hashlib.sha256(), np.zeros(2, np.int64), [], False
        while units := list(itertools.islice(found, most)):
            rows = self.rows(units)
            if not self.counts[rows, 2].all():
                return NOTHING
            digest.update(((";" if begun else "") + ";".join(map(self.groups.__getitem__, rows.tolist()))).encode())
            n, begun = n + self.counts[rows, :2].sum(0), True
            pairs.append((self.a.take(rows)[0].astype(np.int64) << BITS) + self.b.take(rows)[0])
        return int(n[0]), int(n[1]), digest.hexdigest(), np.concatenate(pairs)

    def learn_together(self, some: list[str]) -> None:
        """The new units of several texts at once, so that a round of merges serves all."""
        self.units.of(list({u for x in some for u in self.pattern.findall(" " + x)}))
        self.rows([])


NOTHING = 0, 0, "", np.zeros(0, np.int64)


def _gathered(flat: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of all ids, one behind another."""
    own = lens[ids]
    return flat[np.repeat((np.cumsum(lens) - lens)[ids] - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def _joined(table: list[bytes], ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    each = map(table.__getitem__, ids.tolist())
    return (b"".join(itertools.islice(each, n)) for n in counts.tolist())


TEXTS = "texts array<struct<key:binary,copies:long,n_a:long,n_b:long,n_links:long,groups_sha256:string,pairs:int>>"
#: A bundle: some texts, their distinct pairs, how often each occurs in all copies of its texts, and in ``body`` (compressed) each text's pairs by their numbers.
BUNDLE = f"bundle long, pairs array<long>, counts array<long>, {TEXTS}, entries int, body binary"


def _bundles(byte_path: str, piece_path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), itertools.count()
        aligner = held(("aligned", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))
        rows, held_bytes = [], 0
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 512, 1 << 22):
                if aligner.units.full(aligner.room):
                    aligner.make_room()
                some = part.to_pylist()
                if len(some) > 1:
                    aligner.learn_together(some)
                for key, text, copies in zip(batch.column(0).slice(at, len(some)).to_pylist(), some, batch.column(2).slice(at, len(some)).to_pylist()):
                    n_a, n_b, digest, pairs = aligner.of(text)
                    rows.append((key, copies, n_a, n_b, len(pairs), digest, *np.unique(pairs, return_counts=True)))
                    held_bytes += len(text)
                at += len(some)
                if held_bytes >= size:
                    yield _bundle((partition << 33) + next(made), rows)
                    rows, held_bytes = [], 0
        if rows:
            yield _bundle((partition << 33) + next(made), rows)

    return run


def _bundle(number: int, rows: list[tuple]) -> pa.RecordBatch:
    lens = np.array([len(r[6]) for r in rows], np.int64)
    flat, times = np.concatenate([r[6] for r in rows]), np.concatenate([r[7] for r in rows])
    pairs, place = np.unique(flat, return_inverse=True)
    counts = np.bincount(place, times * np.repeat([r[1] for r in rows], lens), minlength=len(pairs)).astype(np.int64)
    body = pa.compress(np.concatenate([np.diff(place, prepend=0), times]).astype("<i4").tobytes(), codec="zstd", asbytes=True)
    own = [dict(zip(("key", "copies", "n_a", "n_b", "n_links", "groups_sha256"), r), pairs=int(n)) for r, n in zip(rows, lens)]
    columns = [[number], [pairs.tolist()], [counts.tolist()], [own], [len(flat)], [body]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)


_TEXT = pa.struct({"key": pa.binary(), "copies": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.int32()})
SCHEMA = pa.schema({"bundle": pa.int64(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "texts": pa.list_(_TEXT), "entries": pa.int32(), "body": pa.binary()})


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bundle by bundle: first the corpus counts of its pairs, then the bundle."""
    held(("measured",), object)  # nothing to keep, but what other operators left goes
    places, counts, best = [], [], []
    for batch in batches:
        kinds, at = batch.column(1).to_numpy(), 0
        for end in [*np.flatnonzero(kinds == 1).tolist(), len(kinds)]:
            known = batch.slice(at, end - at)
            places.append(known.column(2).to_numpy())
            counts.append(known.column(3).to_numpy())
            best.append(known.column(4).to_numpy(zero_copy_only=False))
            at = end + 1
            if end == len(kinds):
                continue
            row = batch.slice(end, 1)
            place = np.concatenate(places).astype(np.int64)
            n = len(place)
            of, top = np.zeros(n, np.int64), np.zeros(n, bool)
            of[place], top[place] = np.concatenate(counts), np.concatenate(best).astype(bool)
            places, counts, best = [], [], []
            own, entries = row.column(5)[0].as_py(), row.column(6)[0].as_py()
            flat = np.frombuffer(pa.decompress(row.column(7)[0].as_py(), decompressed_size=8 * entries, codec="zstd"), "<i4")
            pair, times = np.cumsum(flat[:entries], dtype=np.int64), flat[entries:].astype(np.int64)
            text = np.repeat(np.arange(len(own)), [x["pairs"] for x in own])
            sums = [np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)]
            np.add.at(sums[0], text, np.where(top[pair], times, 0) if n else times)
            np.add.at(sums[1], text, times * of[pair] if n else times)
            names = ("key", "copies", "n_a", "n_b", "n_links", "groups_sha256")
            yield pa.record_batch([*(pa.array([x[k] for x in own], _TEXT.field(k).type) for k in names), pa.array(sums[0]), pa.array(sums[1])], names=[*names, "n_best", "count_sum"])


def aligned(df: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", bundle_bytes: int = 16 << 20, task_bytes: int = 24 << 20) -> DataFrame:
    """One row per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The byte-level tokenizer (A) reads a space and the text, the piece tokenizer (B) the text. Where
    tokens of both end, a group ends, and these two tokens are a link; a token has a byte at least, so there are as many
    links as groups. The text is shuffled once, whole, and each distinct one is aligned once; a pair's
    corpus count is the sum over distinct texts, times their copies. n_best counts the links whose pair
    is the most frequent of its B id (ties too), count_sum adds the counts of all links.

    Texts are gathered in bundles of ``bundle_bytes`` or one longer text; a bundle asks for each distinct pair once,
    so neither texts nor single links are joined with the counts. Tasks read about ``task_bytes`` of text each. The counts of a B id's best pair are
    broadcast: a row for each id of B's vocabulary at most. Documents find their text again by its
    SHA-256; texts with many copies are joined in parts.

    A null or empty text, or one whose tokens do not give back its bytes (U+2581 is a space to B), has zeros and an
    empty groups_sha256. A null doc_id is kept, repeated rows stay, an empty table gives none. Other
    columns are not read.
    """
    spark = df.sparkSession
    rows = texts(df, doc_id, text).selectExpr("cast(doc_id as long) as doc_id", "nullif(text, '') as text")
    # As many tasks as the size of the texts asks for, so that how many bundles there are does not depend on the session's partitions.
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))
    distinct = rows.filter("text is not null").groupBy("text").agg(F.count("*").alias("copies")).coalesce(tasks).selectExpr("unhex(sha2(text, 256)) as key", "text", "copies")
    path = shared_folder(spark, "bundles")
    distinct.mapInArrow(_bundles(byte_path, piece_path, bundle_bytes), BUNDLE).write.parquet(path)
    bundles = spark.read.parquet(path)

    counted = bundles.selectExpr("explode(arrays_zip(pairs, counts)) as p").groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    counted = cut(counted)
    second = F.col("pair").bitwiseAND((1 << BITS) - 1)
    best = counted.groupBy(second.alias("b")).agg(F.max("count").alias("most"))  # one row for each id of B at most
    values = counted.join(F.broadcast(best), second == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))

    wanted = bundles.selectExpr("bundle", "posexplode(pairs) as (place, pair)")
    asked = wanted.join(values, "pair").selectExpr("bundle", "0 as kind", "place", "count", "best", "null as texts", "null as entries", "null as body")
    whole = bundles.selectExpr("bundle", "1 as kind", "null as place", "null as count", "null as best", "texts", "entries", "body")
    dealt = asked.unionByName(whole).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle").sortWithinPartitions("bundle", "kind")
    measures = cut(dealt.mapInArrow(_measured, "key binary, copies long, n_a long, n_b long, n_links long, groups_sha256 string, n_best long, count_sum long"))

    named = rows.filter("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("of"), F.monotonically_increasing_id().alias("row"))
    found = joined_evenly(named, measures, F.xxhash64("of"), F.xxhash64("key"), F.col("of") == F.col("key"), "copies", "row")
    columns = ["doc_id", "n_a", "n_b", "n_links as n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    none = rows.filter("text is null").selectExpr("doc_id", *(f"0L as {c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), "'' as groups_sha256")
    return found.selectExpr(*columns).unionByName(none)
