"""Ids of a local tokenizers file for many texts: each distinct word is encoded once and remembered."""

from __future__ import annotations

import itertools
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from basalt.llm.common import held

#: One run of Latin letters, then one run of ASCII punctuation; either may be missing. The tokenizer
#: makes one unit of each, and neither Unicode composition nor its white-space rule changes them.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
REGULAR, PUNCTUATION = re.compile(f"[{LETTERS}]*[{MARKS}]*"), re.compile(f"[{MARKS}]+")
#: Any other word, of a text with one space between any two words.
ODD = re.compile(f"(?<![^ ])(?![{LETTERS}]*[{MARKS}]*(?![^ ]))[^ ]+")

#: Letters of both cases with and without accents, punctuation in runs, numerals, other scripts and white space, on which a new file is tried.
PROBE = "The quick-brown Größe NAÏVE don't ... 'tis (a.b) x1y2 100% é\t日本語 \n WORD end!?  ÿß×÷ ſ ﬁ a\u0301"


#: Byte-level tokenizers spell each byte as one visible letter.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip(_VISIBLE, map(chr, _VISIBLE))) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

#: What is remembered has at most so many letters.
MOST_LETTERS = 16 << 20


class Ragged:
    """Rows of integers of different lengths, in one growing array."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lens, self.rows = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def append(self, flat: np.ndarray, lens: np.ndarray) -> None:
        need, rows = self.used + len(flat), self.rows + len(lens)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, 2 * len(self.flat)) - self.used, np.int32)])
        if rows > len(self.lens):
            more = np.zeros(max(rows, 2 * len(self.lens)) - self.rows, np.int64)
            self.starts, self.lens = np.concatenate([self.starts[: self.rows], more]), np.concatenate([self.lens[: self.rows], more])
        self.flat[self.used : need] = flat
        self.lens[self.rows : rows] = lens
        self.starts[self.rows : rows] = self.used + np.cumsum(lens) - lens
        self.used, self.rows = need, rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.lens[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return self.flat[at], lens


class Table:
    """Rows of one width, in one growing array."""

    def __init__(self, width: int, kind: type = np.float64) -> None:
        self.data, self.rows = np.zeros((1 << 12, width), kind), 0

    def append(self, rows: np.ndarray) -> None:
        need = self.rows + len(rows)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.rows], np.zeros((max(need, 2 * len(self.data)) - self.rows, self.data.shape[1]), self.data.dtype)])
        self.data[self.rows : need] = rows
        self.rows = need


def add_up(out: np.ndarray, to: np.ndarray, rows: np.ndarray, table: Table, at_once: int) -> None:
    """Adds the rows of a table to the rows ``to`` of ``out`` (in ascending order), ``at_once`` of them at a time."""
    for at in range(0, len(rows), at_once):
        own = to[at : at + at_once]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(table.data[rows[at : at + at_once]], first, axis=0, dtype=np.float64)


class Numbered(dict):
    """Gives each new key the next number and remembers it as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []
        self.size = 0

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def drain(self) -> list:
        new, self.new = self.new, []
        self.size += sum(map(len, new))
        return new

    def full(self, room: int, size: int = MOST_LETTERS) -> bool:
        """More than ``room`` keys, or than ``size`` letters in all: time to forget them. Nothing but time is lost."""
        return len(self) > room or self.size > size


class Numbers(defaultdict):
    """As ``Numbered``, with less work for a new key: the number is a counter's next, and the new keys are the last ones."""

    def __init__(self) -> None:
        super().__init__(itertools.count().__next__)
        self.known = self.size = 0

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def drain(self) -> list:
        new = list(itertools.islice(reversed(self), len(self) - self.known))[::-1]
        self.known, self.size = len(self), self.size + sum(map(len, new))
        return new

    full = Numbered.full


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space, the number among them of each word in order, and how many words each text has.

    White space at either end of a text, or no text, counts as an empty word.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), pc.list_value_length(split).to_numpy().astype(np.int64)


def _units(text: str) -> tuple[list[str], np.ndarray]:
    """Units of the regular words of a text with one space between any two words, and which word each is of."""
    units = PUNCTUATION.sub("\n\\g<0>", ODD.sub("", text).lower())  # a lower-case letter is one character, too
    edges = np.frombuffer(units.encode(), np.uint8)
    edges = edges[(edges == 10) | (edges == 32)]
    units = units.replace("\n", " ").split(" ")
    some = np.fromiter(map(bool, units), bool, len(units))
    return list(filter(None, units)), np.concatenate([[0], np.cumsum(edges == 32)])[some]


class Remembered:
    """Keys with a row of ids each, about ``room`` keys: when there are more, those met in one call only are forgotten,
    and of the others all but the first half of the room. Nothing but time is lost."""

    def __init__(self, room: int) -> None:
        self.room = room
        self._start()

    def _start(self) -> None:
        self.numbers, self.ids, self.again = Numbers(), Ragged(), np.zeros(1 << 12, bool)

    def make_room(self) -> None:
        if not self.numbers.full(self.room):
            return
        kept, keys = np.flatnonzero(self.again)[: self.room // 2], list(self.numbers)
        keys, flat, lens = [keys[i] for i in kept.tolist()], *self.ids.take(kept)
        self._start()
        if 2 * sum(map(len, keys)) <= MOST_LETTERS:
            self.numbers.of(keys)
            self.numbers.drain()
            self.ids.append(flat, lens)

    def rows(self, keys: list) -> tuple[np.ndarray, list]:
        """The rows of the keys, and the new ones among them, whose ids are to be appended."""
        known, rows = self.numbers.known, self.numbers.of(keys)
        new = self.numbers.drain()
        if self.numbers.known > len(self.again):
            self.again = np.concatenate([self.again, np.zeros(2 * self.numbers.known - len(self.again), bool)])
        self.again[rows[rows < known]] = True
        return rows, new


class WordEncoder:
    """Encodes texts word by word; ASCII white space always ends a word for this kind of tokenizer
    (white space is dropped and no piece goes over it). About ``room`` words are remembered, and as many of their units."""

    def __init__(self, path: str, room: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), True
        self.merger, self.table = self.tokenizer, {}
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.final = np.zeros(self.size, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.units = Remembered(room), Remembered(room)
        self._take_model()
        # A file that follows other rules has no words to remember: its texts go to the tokenizer whole.
        self.by_word = self([PROBE])[0].tolist() == self.tokenizer.encode(PROBE, add_special_tokens=False).ids

    def _take_model(self) -> None:
        """Units are in normal form and not to be split, so the file's model can merge them without the steps before it,
        if only bytes have to be spelt as letters: tried on every letter and mark that units have, and on pairs."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        some = dict.fromkeys(x for c in map(chr, range(33, 256)) if REGULAR.fullmatch(c) for x in (c.lower(), 2 * c.lower()))
        want = self._merged([*some])
        self.merger, self.table = Tokenizer(self.tokenizer.model), {c: "".join(BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.merger.pre_tokenizer = WhitespaceSplit()
        if any(not np.array_equal(x, y) for x, y in zip(want, self._merged([*some]))):
            self.merger, self.table = self.tokenizer, {}

    def __call__(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        if not self.by_word:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            encoded = [np.asarray(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *encoded]), np.array([len(x) for x in encoded], np.int64)
        self.words.make_room()
        words, places, counts = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        rows, new = self.words.rows(words.to_numpy(zero_copy_only=False).tolist())
        self._learn(new)
        ids, lens = self.words.ids.take(rows[places])
        ends = np.concatenate([[0], np.cumsum(lens)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def _learn(self, words: list[bytes]) -> None:
        """Regular words go by their one or two units; any other word goes to the tokenizer as it is."""
        if not words:
            return
        self.units.make_room()
        text = b" ".join(words).decode()
        units, of = _units(text)
        rows, new = self.units.rows(units)
        if new:
            self.units.ids.append(*self._merged(new))
        flat, lens = self.units.ids.take(rows)
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.searchsorted(of, np.arange(len(words) + 1))
        odd, words = set(ODD.findall(text)), text.split(" ")
        odd = [i for i, w in enumerate(words) if w in odd] if odd else []
        lens = np.diff(ends[at])
        if odd:
            encoded = [np.asarray(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)]
            places = np.cumsum(lens)[odd]
            flat = np.insert(flat, np.repeat(places, [len(x) for x in encoded]), np.concatenate(encoded))
            lens[odd] = [len(x) for x in encoded]
        self.words.ids.append(flat, lens)

    def _merged(self, units: list[str], together: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers. Many units go in one call; the ids of each end with the only one that closes a word."""
        if self.table:
            units = [x if x.isascii() else x.translate(self.table) for x in units]
        all_ids, all_lens = [], []
        for a in range(0, len(units), together * 64):
            some = units[a : a + together * 64]
            joined = [" ".join(some[i : i + together]) for i in range(0, len(some), together)]
            flat = np.concatenate([np.asarray(x.ids, np.int32) for x in self.merger.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.final[flat]) + 1
            if len(ends) == len(some):
                lens = np.diff(ends, prepend=0)
            else:
                each = [np.asarray(x.ids, np.int32) for x in self.merger.encode_batch_fast(some, add_special_tokens=False)]
                flat, lens = np.concatenate(each), np.array([len(x) for x in each])
            all_ids.append(flat)
            all_lens.append(lens)
        return np.concatenate(all_ids), np.concatenate(all_lens)


def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, whichever tasks of the operator it runs."""
    return held(("words", path), lambda: WordEncoder(path))
