"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from basalt.llm.common import held, parts, texts

#: Unicode White_Space, which is what \s is in the library's patterns.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts longer than this are cut before the library sees them; so are runs of white space.
LONG, RUN = 1 << 16, 1 << 12


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safely(text: str, long: int = LONG, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """Parts of the text, and whether a part is one single match of the pattern.

    No match goes from other characters on to white space, so each such place is a boundary. A run of
    white space before another character is one match without its last character, which the library's
    backtracking matcher cannot take when the run is very long; such a run is a part of its own.
    """
    start = 0
    for m in re.finditer(f"[{WHITE}]{{{run},}}", text):
        yield from ((x, False) for x in _pieces(text[start : m.start()], long))
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield text[m.start() : end], True
        start = end
    yield from ((x, False) for x in _pieces(text[start:], long))


def _pieces(text: str, long: int) -> Iterator[str]:
    edge = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
    start = 0
    while len(text) - start > long:
        m = edge.search(text, start + long)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    if start < len(text):
        yield text[start:]


def encode(enc: tiktoken.Encoding, text: str, long: int = LONG, run: int = RUN) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit integers, as ``encode_ordinary`` would give them."""
    if len(text) <= run:
        return np.asarray(enc.encode_ordinary(text), dtype="<u4")
    parts = [enc._encode_single_piece(x) if one else enc.encode_ordinary(x) for x, one in split_safely(text, long, run)]
    return np.concatenate([np.asarray(x, dtype="<u4") for x in parts]) if parts else np.zeros(0, "<u4")


def decode(enc: tiktoken.Encoding, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def bpe_encode(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    A null text counts as empty and has no ids; a null doc_id is kept; rows stay as many as they were,
    repeated ones too; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("bpe",), object)  # nothing to keep, but what other operators left goes
        enc = encoding(path, pattern)
        for part in parts(batches, 1, 512):
            ids = [encode(enc, x or "") for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), lists(ids)], names=["doc_id", "ids"])

    return _input(df, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and content (binary) of rows of doc_id and ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("bpe",), object)  # nothing to keep, but what other operators left goes
        enc = encoding(path, pattern)
        for batch in batches:
            content = [decode(enc, x) for x in arrays(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(content, pa.binary())], names=["doc_id", "content"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def bpe_round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of the ids (little-endian 32-bit) and of the bytes they decode to.

    A null text counts as empty, with no ids; a null doc_id is kept; repeated rows stay; an empty table
    gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("bpe",), object)  # nothing to keep, but what other operators left goes
        enc = encoding(path, pattern)
        for part in parts(batches, 1, 512):
            n, a, b = [], [], []
            for x in part.column(1).to_pylist():
                ids = encode(enc, x or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(decode(enc, ids)).hexdigest())
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _input(df, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _input(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return texts(df, doc_id, text).selectExpr("cast(doc_id as long) as doc_id", "text")


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).astype("<u4")
    ends = column.offsets.to_numpy()
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]
