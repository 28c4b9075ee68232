"""SentencePiece byte-pair encoding in numpy: all new words of a batch are merged together, round by round."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from basalt.llm.bpe import lists
from basalt.llm.common import held, slices, texts
from basalt.llm.words import Numbered, Ragged

#: The sign that stands for a space in pieces.
SPACE = "▁"


class Vocabulary:
    """The symbols of a model, which pairs of them merge, and in which order.

    A symbol is a piece, or a character that is none (numbered after the pieces). ``order`` is smaller the
    sooner a piece is made; pieces of one score share it, as the library takes the leftmost of them.
    """

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        _only_plain_bpe(self.library)
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        made = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.number = {self.pieces[i]: i for i in made}
        self.bytes_from = self.library.piece_to_id("<0x00>")
        scores = np.array([self.library.get_score(i) for i in range(n)], np.float32)
        order = np.searchsorted(np.unique(-scores), -scores)

        several = [p for p in self.number if len(p) > 1]
        symbols = dict(self.number)
        for c in sorted({c for p in several for c in p}):
            symbols.setdefault(c, len(symbols) + n)
        self.width = n + len(symbols) + 1
        pairs = [(symbols[p[:k]] * self.width + symbols[p[k:]], self.number[p]) for p in several for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        pairs.sort()
        self.keys, self.into = (np.array(x, np.int64) for x in zip(*pairs))
        self.order = order[self.into]
        self.tables = _hashed(self.keys)
        self.symbols, self.other = symbols, self.width - 1  # ``other``: characters that no piece has

        # Nothing merges over a place between two characters where no piece holds the second one after another.
        later = {b for p in several for a, b in zip(p, p[1:]) if not a == b == SPACE}
        self.parts_at_spaces = SPACE not in later
        self.alone = [c for c in "\n\t" if not any(c in p for p in several)]
        # Where pieces of spaces only are the very last ones to be made, and no other piece has two spaces, a run of spaces
        # may go by its longest blocks from the left; tried on runs of up to three blocks.
        runs = [i for p, i in self.number.items() if set(p) == {SPACE} and len(p) > 1]
        self.block = max((len(self.pieces[i]) for i in runs), default=1)
        others = [i for p, i in self.number.items() if set(p) != {SPACE}]
        apart = bool(runs) and not any(SPACE * 2 in self.pieces[i] for i in others) and order[runs].min() > order[others].max()
        self.blocks = apart and all(self._run(k) == self._run(self.block) * (k // self.block) + self._run(k % self.block) for k in range(3 * self.block + 1))

    def _run(self, k: int) -> list[int]:
        return merged(np.full(k, self.symbols[SPACE]), np.zeros(k, np.int64), self)[0].tolist()

    def units(self) -> re.Pattern:
        """Parts of a text (spaces already replaced) that are encoded each on its own: no piece goes over their borders."""
        if not self.parts_at_spaces:
            return re.compile("(?s).+")
        alone = "".join(re.escape(c) for c in self.alone)
        own = f"|[{alone}]" if alone else ""
        block = f"{SPACE}{{{self.block}}}(?={SPACE})|" if self.blocks else ""
        return re.compile(f"{block}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{own}")


def _hashed(keys: np.ndarray, bits: int = 20) -> list[np.ndarray]:
    """Tables of places in ``keys`` by a hash of the key; a key that finds its slot taken goes to the next table."""
    tables, left = [], np.arange(len(keys))
    while len(left):
        table = np.full(1 << bits, -1)
        table[_slots(keys[left], len(tables), bits)] = left
        tables.append(table)
        left = left[table[_slots(keys[left], len(tables) - 1, bits)] != left]
    return tables


def _slots(keys: np.ndarray, nth: int, bits: int = 20) -> np.ndarray:
    return (keys * (0x1E3779B97F4A7C15 + 2 * nth * 0x632BE59BD9B4E019 & (1 << 62) - 1 | 1)) >> (63 - bits) & (1 << bits) - 1


def _only_plain_bpe(model: sentencepiece.SentencePieceProcessor) -> None:
    """Models that normalise their texts, have pieces of the user's own, or fall back on no bytes follow rules that are not kept here."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    normal, trainer = proto.normalizer_spec, proto.trainer_spec
    plain = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
    plain &= normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    if not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
        raise ValueError("a byte-pair model with byte fallback, leading spaces and no other normalisation is needed")


def merged(symbols: np.ndarray, words: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their words (ascending numbers) after all merges.

    Every round each word makes the merges of its least order, the leftmost first and none that overlap;
    what is left is compacted. Where a merge makes a pair that goes before (or with) the order of the
    round, the merges right of it wait: one at a time from the left is what the library does.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        order, into = _pairs(symbols, words, vocabulary)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        least = np.minimum.reduceat(order, first)
        open_ = least < NONE
        # Words in which no pair remains leave the rounds.
        ends = np.append(first[1:], len(words))
        stay = np.repeat(open_, ends - first)
        if not stay.all():
            done.append((symbols[~stay], words[~stay]))
            symbols, words, order, into = symbols[stay], words[stay], order[stay], into[stay]
            if not len(symbols):
                break
            first = np.flatnonzero(np.diff(words, prepend=-1))
            least = least[open_]
            ends = np.append(first[1:], len(words))
        word = np.repeat(np.arange(len(first)), ends - first)
        at = np.flatnonzero(order == least[word])
        # Of candidates that stand side by side every second one, from the left of their row.
        row = np.flatnonzero(np.diff(at, prepend=-9) != 1)
        nth = np.arange(len(at)) - np.repeat(row, np.diff(np.append(row, len(at))))
        at = at[nth % 2 == 0]

        symbols_new, keep = symbols.copy(), np.ones(len(symbols), bool)
        symbols_new[at], keep[at + 1] = into[at], False
        # Pairs that the merge at ``at`` makes: with what is left of it by then, and with the symbol right of it.
        left = np.maximum(at - 1, 0)
        left = np.where(keep[left], left, np.maximum(left - 1, 0))
        made = np.minimum(
            _order(symbols_new[left], into[at], (at > 0) & (words[left] == words[at]), vocabulary),
            _order(into[at], symbols[np.minimum(at + 2, len(symbols) - 1)], (at + 2 < len(symbols)) & (words[np.minimum(at + 2, len(symbols) - 1)] == words[at]), vocabulary),
        )
        early = made <= least[word[at]]
        if early.any():
            # Of each word the merges up to its first early one; the others wait for the next round.
            n_early = np.cumsum(early) - early
            begins = np.flatnonzero(np.diff(word[at], prepend=-1))
            before = n_early - np.repeat(n_early[begins], np.diff(np.append(begins, len(at))))
            at = at[before == 0]
            symbols_new, keep = symbols.copy(), np.ones(len(symbols), bool)
            symbols_new[at], keep[at + 1] = into[at], False
        symbols, words = symbols_new[keep], words[keep]
    if not done:
        return symbols, words
    symbols, words = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    by_word = np.argsort(words, kind="stable")
    return symbols[by_word], words[by_word]


NONE = np.iinfo(np.int64).max


def _lookup(left: np.ndarray, right: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each pair its place among the vocabulary's pairs, and whether it is one of them."""
    key = left.astype(np.int64) * vocabulary.width + right
    at = vocabulary.tables[0][_slots(key, 0)]
    known = vocabulary.keys[at] == key
    for nth in range(1, len(vocabulary.tables)):
        rest = np.flatnonzero(~known & (at >= 0))  # an empty slot says that no table has the key
        if not len(rest):
            break
        at[rest] = vocabulary.tables[nth][_slots(key[rest], nth)]
        known[rest] = vocabulary.keys[at[rest]] == key[rest]
    return at, known


def _order(left: np.ndarray, right: np.ndarray, of_one_word: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    at, known = _lookup(left, right, vocabulary)
    return np.where(known & of_one_word, vocabulary.order[at], NONE)


def _pairs(symbols: np.ndarray, words: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the order of its merge with the next one of its word (NONE if they don't merge) and the piece that they make."""
    order, into = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
    at, known = _lookup(symbols[:-1], symbols[1:], vocabulary)
    known &= words[:-1] == words[1:]
    order[:-1][known] = vocabulary.order[at[known]]
    into[:-1][known] = vocabulary.into[at[known]]
    return order, into


class PieceEncoder:
    """Ids of texts by their units; each distinct unit is merged once and remembered, ``room`` of them at most."""

    def __init__(self, path: str, room: int = 200_000) -> None:
        self.vocabulary, self.room = Vocabulary(path), room
        self.pattern = self.vocabulary.units()
        self.decimal = [str(i) for i in range(self.vocabulary.library.vocab_size())]
        self.anchor = next(i for p, i in self.vocabulary.number.items() if p.isascii() and p.isalpha())
        self.forget()

    def forget(self) -> None:
        self.units, self.ids, self.texts = Numbered(), Ragged(), []

    def rows(self, units: list[str]) -> np.ndarray:
        """The numbers of units, new ones encoded."""
        found = self.units.of(units)
        new = self.units.drain()
        if new:
            flat, lens = self.encoded(new)
            self.ids.append(flat.astype(np.int32), lens)
            each = map(self.decimal.__getitem__, flat.tolist())
            self.texts += [",".join(itertools.islice(each, n)) for n in lens.tolist()]
        return found

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has."""
        v = self.vocabulary
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        letters, place = np.unique(codes, return_inverse=True)
        known = np.array([v.symbols.get(chr(c), v.other) for c in letters], np.int64)[place]
        # Characters that no piece has stand as themselves beyond all symbols, so that they can be told afterwards.
        raw = np.where(known == v.other, v.width + codes.astype(np.int64), known)
        symbols, words = merged(raw, np.repeat(np.arange(len(units)), sizes), v)
        lens = np.bincount(words, minlength=len(units))
        odd = np.flatnonzero(symbols >= v.library.vocab_size())
        if len(odd):
            names = {i: c for c, i in v.symbols.items() if i >= v.library.vocab_size()}
            spelt = [(names[s] if s in names else chr(s - v.width)).encode() for s in symbols[odd].tolist()]
            more = np.array([len(x) for x in spelt])
            lens = lens + np.bincount(words[odd], more - 1, minlength=len(units)).astype(np.int64)
            size = np.ones(len(symbols), np.int64)
            size[odd] = more
            symbols = np.repeat(symbols, size)
            starts = np.cumsum(size) - size
            at = np.repeat(starts[odd] - (np.cumsum(more) - more), more) + np.arange(more.sum())
            symbols[at] = v.bytes_from + np.frombuffer(b"".join(spelt), np.uint8)
        return symbols, lens

    def parts(self, text: str, most: int = 1 << 16) -> Iterator[list[str]]:
        """The units of a text, so many at once."""
        if not text:
            return
        found = (m[0] for m in self.pattern.finditer(SPACE + text.replace(" ", SPACE)))
        while part := list(itertools.islice(found, most)):
            yield part

    def decode(self, ids: list[int], begins: bool) -> str:
        """The library's decoding; a later part of a text is decoded behind a letter, since the first space of a text is not kept."""
        if begins:
            return self.vocabulary.library.decode(ids)
        return self.vocabulary.library.decode([self.anchor, *ids])[len(self.vocabulary.pieces[self.anchor]) :]


def encoder_of(path: str) -> PieceEncoder:
    encoder = held(("pieces", path), lambda: PieceEncoder(path))
    if encoder.units.full(encoder.room):
        encoder.forget()
    return encoder


def piece_encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text, as the sentencepiece library gives them without begin and end.

    A null text counts as empty and has no ids; a null doc_id is kept; rows stay as many as they were,
    repeated ones too; an empty table gives none. Other columns are not read. One text is held in full,
    its units in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, some in _sliced(batches):
            encoder = encoder_of(path)
            if len(some) == 1:
                found = [encoder.ids.take(encoder.rows(part))[0] for part in encoder.parts(some[0] or "")]
                ids = [np.concatenate([np.zeros(0, np.int32), *found])]
            else:
                ids = [x for _, x in encoded_together(encoder, [x or "" for x in some])]
            yield pa.record_batch([docs, lists(ids)], names=["doc_id", "ids"])

    return _input(df, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def piece_decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids, by the library's decode; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder_of(path).vocabulary.library
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([library.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_round_trip(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the text that they decode to.

    A null text counts as empty: no ids, and both digests are of nothing. A null doc_id is kept; repeated
    rows stay; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, some in _sliced(batches):
            encoder = encoder_of(path)
            some = [x or "" for x in some]
            found = [_digests(encoder, some[0])] if len(some) == 1 else list(_digests_together(encoder, some))
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.record_batch([docs, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(df, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digests(encoder: PieceEncoder, text: str) -> tuple[int, str, str]:
    """Of one text in parts, however long it is."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    for part in encoder.parts(text):
        rows = encoder.rows(part)
        ids = encoder.ids.take(rows)[0].tolist()
        of_ids.update((("," if n else "") + ",".join(map(encoder.texts.__getitem__, rows.tolist()))).encode())
        of_text.update(encoder.decode(ids, n == 0).encode())
        n += len(ids)
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _digests_together(encoder: PieceEncoder, some: list[str]) -> Iterator[tuple[int, str, str]]:
    """Of several texts, so that a round of merges serves the new words of all."""
    for rows, ids in encoded_together(encoder, some):
        ids = ids.tolist()
        joined = ",".join(map(encoder.texts.__getitem__, rows.tolist()))
        yield len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids, True).encode()).hexdigest()


def encoded_together(encoder: PieceEncoder, some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the units of each text, and its ids."""
    units = [encoder.pattern.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in some]
    rows = encoder.rows([u for own in units for u in own])
    ids, lens = encoder.ids.take(rows)
    ends = np.concatenate([[0], np.cumsum(lens)])
    at = 0
    for own in units:
        to = at + len(own)
        yield rows[at:to], ids[ends[at] : ends[to]]
        at = to


def _input(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts(df, doc_id, text).selectExpr("cast(doc_id as long) as doc_id", "text")


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.Array, list[str | None]]]:
    for batch in batches:
        at = 0
        for part in slices(batch.column(1), rows, 1 << 22):
            yield batch.column(0).slice(at, len(part)), part.to_pylist()
            at += len(part)
