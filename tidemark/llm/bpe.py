"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can be bridged by no merge, so a text may be cut there. Cuts are made
only between characters, never after white space and never beside an apostrophe, so that the tokenizer's own pattern
(which looks ahead after white space and knows contractions) sees what it would have seen in the whole text. Special
strings are fragments of their own. Every distinct fragment is encoded once by the library; texts get the fragments'
ids one after the other.

Scale: one pass over the documents, no shuffle; memory is a few MB of text and a bounded memo of fragments per task.

Edge cases: null and empty texts have no ids; decoding null ids gives null, unknown or null ids inside an array are
left out, invalid UTF-8 becomes U+FFFD; other columns stay as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import sliced, text_buffers

TOKENIZER = "byte_bpe_50k.json"
#: Fragments that a task remembers before it forgets them all.
MEMO_FRAGMENTS = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def white_space_ends(data: np.ndarray) -> np.ndarray:
    """Which bytes are the last of a white-space character (control separators counted in, to be safe)."""
    one = np.zeros(256, bool)
    one[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    out = one[data]
    if (data >= 128).any():
        b1 = np.concatenate([[0], data[:-1]]).astype(np.uint8)
        b2 = np.concatenate([[0, 0], data[:-2]]).astype(np.uint8)[: len(data)]
        out |= (b1 == 0xC2) & ((data == 0x85) | (data == 0xA0))
        out |= (b2 == 0xE2) & (b1 == 0x80) & ((data <= 0x8A) & (data >= 0x80) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
        out |= (b2 == 0xE1) & (b1 == 0x9A) & (data == 0x80) | (b2 == 0xE2) & (b1 == 0x81) & (data == 0x9F) | (b2 == 0xE3) & (b1 == 0x80) & (data == 0x80)
    return out


class Codec:
    """One tokenizer file, in one process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_of_char()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = sorted((t.content.encode() for t in added.values()), key=len, reverse=True)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        self.inside = np.zeros((256, 256), bool)
        for token, i in vocabulary.items():
            raw = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
            self.token_bytes[i] = raw
            for pair in zip(raw, raw[1:], strict=False):
                self.inside[pair] = True
        self.inside[:, 0x27] = self.inside[0x27, :] = True
        self.inside[:, 0x80:0xC0] = True  # not within a character
        self.table = pa.array(self.token_bytes, pa.binary())
        self.memo: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin and end, ends of texts included."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self.inside[data[:-1], data[1:]] & ~white_space_ends(data)[:-1]
            raw = data.tobytes()
            for special in self.special:
                at = raw.find(special)
                while at >= 0:
                    end = at + len(special)
                    if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):
                        cut[at:end + 1] = False
                        cut[[at, end]] = True
                        at = raw.find(special, end)
                    else:
                        at = raw.find(special, at + 1)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n + 1 offsets into them."""
        data, offsets = text_buffers(column)
        bounds = self.cuts(data, offsets)
        fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct, number = fragments.dictionary.to_pylist(), fragments.indices.to_numpy()
        if len(self.memo) > MEMO_FRAGMENTS:
            self.memo.clear()
        new = [x for x in distinct if x not in self.memo]
        for x, encoding in zip(new, self.tokenizer.encode_batch([x.decode() for x in new], add_special_tokens=False), strict=True):
            self.memo[x] = encoding.ids
        ids = [self.memo[x] for x in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        size = sizes[number]
        ends = np.cumsum(size)
        taken = flat[np.repeat(begin[number] - (ends - size), size) + np.arange(int(size.sum()))] if len(number) else flat
        return taken, np.concatenate([[0], ends])[np.searchsorted(bounds, offsets)]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        values = ids.flatten()
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(self.table)))
        pieces = pc.fill_null(self.table.take(pc.if_else(known, values, None)), b"")
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        raw = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), b"")
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, path: str, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """documents with the array column `to` of token ids."""
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in sliced(batches, at):
            ids, offsets = own.encode(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], [*batch.schema.names, to])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", to: str = "decoded_text") -> DataFrame:
    """encoded with the text column `to` that its token ids stand for, special tokens written out."""
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for whole in batches:
            step = max(1, min(whole.num_rows, int(whole.num_rows * (1 << 20) / max(1, len(whole.column(at).flatten())))))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(batch.column(at))], [*batch.schema.names, to])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(to, T.StringType())]))


def encode_decode(documents: DataFrame, path: str, text_col: str = "text", to: tuple[str, str] = ("token_ids", "decoded_text")) -> DataFrame:
    """documents without their text, but with its token ids and what these decode to, in one pass of one worker."""
    at = documents.columns.index(text_col)
    others = [i for i in range(len(documents.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in sliced(batches, at, 1 << 20):
            ids, offsets = own.encode(batch.column(at))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), lists, own.decode(lists)], [*(batch.schema.names[i] for i in others), *to])

    kinds = T.ArrayType(T.IntegerType()), T.StringType()
    return documents.mapInArrow(run, T.StructType([*(documents.schema.fields[i] for i in others), *(T.StructField(n, k) for n, k in zip(to, kinds, strict=True))]))


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token_ids themselves."""
    ids = F.col("token_ids")
    return encode_decode(documents.select("doc_id", "text"), path or tokenizer_path()).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"),
        "token_ids",
    )
