"""Byte-level BPE over Arrow batches, with the ``tokenizers`` library.

A text is cut by the vocabulary's pattern; the distinct pieces of a batch are
encoded together by the library, and a bounded cache keeps their ids for later
batches. A token's bytes follow from its printable form through the byte
table, so token offsets are sums of byte lengths, mapped to code points by
counting the bytes that begin one. Decoding joins the bytes, which mends
characters that tokens have split.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import carried, grams
from .columns import free

#: Distinct pieces that a task remembers.
CACHE_PIECES = 200_000
#: Text taken at once. Its pieces are Python strings, many times the size of the text.
TEXT_BYTES = 1 << 20
#: New pieces given to the library at once; what it returns is large.
NEW_PIECES = 4_096


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Vocabulary:
    """A task's tokenizer, the bytes of its tokens, and the cache of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        import os

        # A task has one core; the library's own threads would each hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.cut = regex.compile(pattern).findall
        self.library = Tokenizer.from_file(path)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.library.encode_special_tokens = True
        self.bytes, self.offsets = token_bytes(path)
        self.reset()

    def reset(self) -> None:
        # A new piece gets the next number when it is looked up.
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        if len(self.number) > CACHE_PIECES:
            self.reset()
        cuts = [self.cut(t) for t in texts]
        n = np.fromiter(map(len, cuts), np.int64, len(cuts))
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cuts)), np.int64, int(n.sum()))
        new = islice(self.number, known, None)
        while step := list(islice(new, NEW_PIECES)):
            found = [e.ids for e in self.library.encode_batch_fast(step, add_special_tokens=False)]
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int64)])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        size = self.ends[at + 1] - self.ends[at]
        bounds = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[spread(self.ends[at], size)]
        return ids, bounds[np.concatenate([[0], np.cumsum(n)])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 for each pair, one after another."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and each token's offset."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    table = byte_table()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for shown, i in vocabulary.items():
        tokens[i] = bytes(table[c] for c in shown) if all(c in table for c in shown) else shown.encode()
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _list(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _joined(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each row's tokens; a row's ids lie between two bounds."""
    size = offsets[ids + 1] - offsets[ids]
    out = data[spread(offsets[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[bounds].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def encode(
    df: DataFrame, vocabulary: str, pattern: str, text: str = "text", id: str = "doc_id", offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """``id``, ``ids`` and on request ``starts`` and ``ends`` of each token in code points.

    With ``decoded`` the ids are at once decoded as by ``decode``, in the same
    task: a round trip then needs no second Python worker for the ids.

    ``vocabulary`` is a byte-level file of the library, ``pattern`` its cutting
    rule. No special tokens are made. A token that holds part of a character
    spans the whole character. Null and empty texts have no tokens. Rows are
    encoded one by one, so repeated ids and null ids stay as they are; other
    columns are not carried.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Vocabulary(vocabulary, pattern)
        for batch in batches:
            for piece in grams.pieces(batch.column(1), TEXT_BYTES):
                rows = slice(piece.first, piece.last)
                texts = [t or "" for t in batch.column(1)[rows].to_pylist()]
                ids, bounds = own.encode(texts)
                columns = [batch.column(0)[rows], _list(ids, bounds)]
                if offsets:
                    size = own.offsets[ids + 1] - own.offsets[ids]
                    ends = np.cumsum(size)
                    begins = (piece.data & 0xC0) != 0x80
                    chars = np.concatenate([[0], np.cumsum(begins)])
                    n = np.diff(bounds)
                    base = np.repeat(chars[piece.offsets[:-1]], n)
                    first = chars[np.minimum(ends - size + 1, len(piece.data))] - 1
                    columns += [_list(first - base, bounds), _list(chars[ends] - base, bounds)]
                if decoded:
                    columns.append(_joined(own.bytes, own.offsets, ids, bounds))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "ids", *(["starts", "ends"] if offsets else []), *(["decoded"] if decoded else [])]
    schema = "id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "") + (", decoded binary" if decoded else "")
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(each, schema).withColumnRenamed("id", id)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``ids``, with the text that the ids decode to in place of ``text``; a null text becomes empty."""
    ids, again = free(df, ids), free(df, "decoded")
    at = df.columns.index(text)

    def begin() -> carried.Compute:
        own = _Vocabulary(vocabulary, pattern)

        def compute(batch: pa.RecordBatch, piece: grams.Piece) -> list[pa.Array]:
            found, bounds = own.encode([t or "" for t in batch.column(at)[piece.first : piece.last].to_pylist()])
            return [_list(found, bounds), _joined(own.bytes, own.offsets, found, bounds)]

        return compute

    out = carried.with_columns(df, text, [(ids, T.ArrayType(T.IntegerType())), (again, T.BinaryType())], begin, TEXT_BYTES)
    return out.withColumn(text, F.col(again).cast("string")).drop(again)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded``: the bytes of the tokens, joined. Null ids decode to nothing.

    If ``df`` has a column of that name, the new one gets underscores at its end.
    """
    decoded = free(df, "decoded")
    names = [*df.columns, decoded]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, offsets = token_bytes(vocabulary)
        for batch in batches:
            column = batch.column(names.index(ids))
            for first in range(0, len(column), STEP):
                part = column[first : first + STEP]
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.fromiter((len(x) if x.is_valid else 0 for x in part), np.int64, len(part))
                raw = _joined(data, offsets, flat, np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([*(c[first : first + STEP] for c in batch.columns), raw], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(each, f"{fields}, `{decoded}` binary")


#: Rows decoded at once.
STEP = 256
