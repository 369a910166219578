"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every document.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. A window is ``n`` consecutive words of
a benchmark item; an item with fewer words is one window. A document word inside any occurrence of a window is a hit.
Candidate windows are found by 64-bit hashes and verified by their words before they count.

Scale: the documents are scanned once, in place, without a shuffle. The benchmark's windows are broadcast only if their
measured number and size stay under the bounds below; for a larger benchmark the windows of each distinct text are joined
by hash with the benchmark's distinct windows, and what meets is verified by its words likewise.

Edge cases: a null or empty text has no words; benchmark rows with a null id or without words have no windows; repeated
rows are judged one by one; a repeated item id counts once; other columns of the input are passed through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import SpanHasher, fresh, materialise, mix, runs, sliced, text_buffers

WINDOW_WORDS = 10
#: Broadcast bounds: number of distinct windows and bytes of their words.
MAX_WINDOWS, MAX_WINDOW_BYTES = 400_000, 48 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the first word of each text (n + 1)."""
    data, offsets = text_buffers(column)
    data = LOWER[data]
    starts, ends = runs(WORD[data], offsets)
    return data, starts, ends, np.searchsorted(starts, offsets)


def window_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive words (windows across texts included; callers leave those out)."""
    m = len(word_hashes) - n + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(n if m > 0 else 0):
        out = out * STEP + word_hashes[k : k + m]
    return mix(out)


def starts_of_windows(first: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the words at which a whole window of n words begins."""
    inside = np.zeros(int(first[-1]) + 1, np.int32)
    long = np.diff(first) >= n
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[:-1] > 0)


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, key): each item's distinct windows; key is their words joined by spaces."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            data, starts, ends, first = words(batch.column(1))
            raw, rows = data.tobytes(), []
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = [raw[s:e] for s, e in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist(), strict=True)]
                size = min(n, len(own))
                rows += [(item, size, key) for key in {b" ".join(own[k : k + size]) for k in range(len(own) - size + 1)} if size]
            if rows:
                item, size, key = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(key, pa.binary())], ["item_id", "size", "key"])

    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(split, "item_id string, size int, key binary").distinct()


class WindowSet:
    """The benchmark's windows in a task: items by the words of a window, with sorted hashes and a bitmap in front."""

    BITS = 22

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        self.items: dict[bytes, tuple[str, ...]] = {}
        for item, _, key in rows:
            key = bytes(key)
            self.items[key] = (*self.items.get(key, ()), item)
        self.sizes = sorted({size for _, size, _ in rows})
        self.hashes: dict[int, np.ndarray] | None = None

    def prepare(self) -> None:
        if self.hashes is None:
            self.hasher, self.hashes, self.bitmaps = SpanHasher(0x100000001B3), {}, {}
            by_size: dict[int, list[bytes]] = {n: [] for n in self.sizes}
            for key in self.items:
                by_size[key.count(b" ") + 1].append(key)
            for n, keys in by_size.items():
                data, starts, ends, first = words(pa.array(keys, pa.binary()))
                hashes = window_hashes(self.hasher(data, starts, ends), n)[first[:-1]]
                self.hashes[n] = np.unique(hashes)
                self.bitmaps[n] = np.zeros(1 << self.BITS, bool)
                self.bitmaps[n][hashes >> np.uint64(64 - self.BITS)] = True

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
        """Starts and ends of words (bytes), first word of each text, which words are hit, items of each text."""
        self.prepare()
        data, starts, ends, first = words(column)
        found: list[set[str]] = [set() for _ in range(len(column))]
        cover = np.zeros(len(starts) + 1, np.int32)
        if len(starts) and self.sizes:
            hashes = self.hasher(data, starts, ends)
            for n in self.sizes:
                at = starts_of_windows(first, n)
                h = window_hashes(hashes, n)[at]
                keep = self.bitmaps[n][h >> np.uint64(64 - self.BITS)]
                at, h = at[keep], h[keep]
                place = np.minimum(np.searchsorted(self.hashes[n], h), len(self.hashes[n]) - 1)
                at = at[self.hashes[n][place] == h]
                for k, doc in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist(), strict=True):
                    key = b" ".join(data[s:e].tobytes() for s, e in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True))
                    if key in self.items:
                        found[doc].update(self.items[key])
                        cover[k] += 1
                        cover[k + n] -= 1
        return starts, ends, first, np.cumsum(cover)[:-1] > 0, found


def without_hits(text: bytes | None, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> bytes | None:
    """text less each span from the first to the last word of a run of hit words."""
    if text is None or not hit.any():
        return text
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, last = [], 0
    for a, b in zip(edges[::2], edges[1::2] - 1, strict=True):
        out.append(text[last : starts[a]])
        last = ends[b]
    return b"".join([*out, text[last:]])


RESULT = [("n_words", T.LongType(), pa.int64()), ("n_hit", T.LongType(), pa.int64()), ("items", T.ArrayType(T.StringType()), pa.list_(pa.string())), ("clean_text", T.StringType(), pa.string())]


def scan(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS, text_col: str = "text", max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_WINDOW_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """documents with n_words, n_hit, items (sorted ids of the items found) and clean_text (hit spans removed).

    Also returns the names that these columns got, which differ where documents has such a column already."""
    names = {}
    for name, *_ in RESULT:
        names[name] = fresh(name, [*documents.columns, *names.values()])
    windows = benchmark_windows(benchmark, n)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("b")).first()
    if size.n > max_windows or size.b > max_bytes:
        return _scan_by_join(documents, windows, n, text_col, names), names
    shared = documents.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in windows.collect()]))
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at, 1 << 20):
            column = batch.column(at)
            starts, ends, first, hit, found = shared.value.find(column)
            _, offsets = text_buffers(column)
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
            clean = column.cast(pa.string())
            if hit.any():
                texts = clean.to_pylist()
                for i in np.flatnonzero(n_hit):
                    s = slice(first[i], first[i + 1])
                    texts[i] = without_hits(texts[i].encode(), starts[s] - offsets[i], ends[s] - offsets[i], hit[s]).decode()
                clean = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first)), pa.array(n_hit), pa.array([sorted(x) for x in found], pa.list_(pa.string())), clean], [*batch.schema.names, *names.values()])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(names[name], kind) for name, kind, _ in RESULT)])
    return documents.mapInArrow(run, schema), names


def _scan_by_join(documents: DataFrame, windows: DataFrame, n: int, text_col: str, names: dict[str, str]) -> DataFrame:
    """The same by a shuffle. A text that many rows share is hashed and verified once; a window that many items share is
    one row until its text is known to hold it."""
    windows = materialise(windows, "benchmark-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n values at most

    def hashed(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = SpanHasher(0x100000001B3)
            for batch in sliced(batches, 1, 1 << 20):
                data, starts, ends, first = words(batch.column(1))
                per_word = hasher(data, starts, ends)
                for size in sizes:
                    at = starts_of_windows(first, size)
                    doc = np.searchsorted(first, at, "right") - 1
                    if whole:  # a benchmark window is its row's whole text
                        keep = np.diff(first)[doc] == size
                        at, doc = at[keep], doc[keep]
                    h = window_hashes(per_word, size)[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(np.full(len(at), size, np.int32)), pa.array(h), pa.array(at - first[doc])], ["id", "size", "h", "at"])

        return run, "id binary, size int, h long, at long"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1 << 20):
            data, starts, ends, first = words(batch.column(1))
            found = []
            for i, candidates in enumerate(batch.column(2).to_pylist()):
                digest = batch.column(0)[i].as_py()
                for c in candidates:
                    k = int(first[i]) + c["at"]
                    if b" ".join(data[s:e].tobytes() for s, e in zip(starts[k : k + c["size"]].tolist(), ends[k : k + c["size"]].tolist(), strict=True)) == c["key"]:
                        found.append((digest, c["at"], c["size"], c["key"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["id", "at", "size", "key"])

    digest, items, at = (fresh(x, [*documents.columns, *names.values()]) for x in ("text_digest", "hit_items", "hit_at"))
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    texts = documents.select(sha.alias("id"), F.col(text_col).cast("binary").alias("text")).dropDuplicates(["id"])
    distinct = windows.select("key").distinct()
    known = distinct.select("key", "key").toDF("id", "text").mapInArrow(*hashed(True)).select(F.col("id").alias("key"), "size", "h")
    own = texts.mapInArrow(*hashed(False))
    met = own.join(known, ["size", "h"]).groupBy("id").agg(F.collect_list(F.struct("at", "size", "key")).alias("candidates"))
    verified = materialise(texts.join(met, "id").select("id", "text", "candidates").mapInArrow(verify, "id binary, at long, size int, key binary"), "verified-windows")
    by_text = verified.groupBy("id").agg(F.collect_list(F.struct("at", "size")).alias(at))
    by_item = verified.select("id", "key").distinct().join(windows.select("key", "item_id"), "key").groupBy("id").agg(F.array_sort(F.collect_set("item_id")).alias(items))
    hits = materialise(by_text.join(by_item, "id").withColumnRenamed("id", digest), "hits-of-texts")
    joined = documents.withColumn(digest, sha).join(hits, digest, "left").select(*documents.columns, items, at)
    column, n_own = documents.columns.index(text_col), len(documents.columns)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            _, starts, ends, first = words(batch.column(column))
            _, offsets = text_buffers(batch.column(column))
            texts, n_hit = batch.column(column).cast(pa.string()).to_pylist(), []
            for i, places in enumerate(batch.column(n_own + 1).to_pylist()):
                s = slice(first[i], first[i + 1])
                hit = np.zeros(int(first[i + 1] - first[i]), bool)
                for p in places or ():
                    hit[p["at"] : p["at"] + p["size"]] = True
                n_hit.append(int(hit.sum()))
                if n_hit[-1]:
                    texts[i] = without_hits(texts[i].encode(), starts[s] - offsets[i], ends[s] - offsets[i], hit).decode()
            found = [x or [] for x in batch.column(n_own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_own], pa.array(np.diff(first)), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())], [*batch.schema.names[:n_own], *names.values()])

    schema = T.StructType([*documents.schema.fields, *(T.StructField(names[name], kind) for name, kind, _ in RESULT)])
    return joined.mapInArrow(finish, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, action: str = "document", n: int = WINDOW_WORDS, text_col: str = "text") -> DataFrame:
    """documents, with the same columns, after removal: action "document" drops contaminated rows, "span" cuts the hit spans."""
    found, names = scan(documents, benchmark, n, text_col)
    if action == "document":
        return found.where(F.col(names["n_hit"]) == 0).select(*documents.columns)
    if action != "span":
        raise ValueError("action is 'document' or 'span'")
    return found.select(*(F.col(names["clean_text"]).alias(c) if c == text_col else F.col(c) for c in documents.columns))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, names = scan(documents.select("doc_id", "text"), benchmark)
    items = F.col(names["items"])
    return found.select("doc_id", F.col(names["n_words"]).alias("n_words"), F.col(names["n_hit"]).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col(names["n_hit"]) > 0).alias("contaminated"))
