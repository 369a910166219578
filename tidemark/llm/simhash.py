"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints take 4-word shingles and 64-bit hashes. For radius r the 2^(r+1) - 1 masks are made from random vectors
phi(i) of r + 1 bits, one for each of the 64 bit positions: mask v holds bit i where <v, phi(i)> is odd. For any r
positions some v is orthogonal to all their phi, so two fingerprints that differ in at most r bits agree under that
mask: every pair within the radius meets in some table. What meets is then compared exactly.

Scale: fingerprints come from one pass; equal ones are one node from then on, whatever their number. A table's bucket
gives a spanning star of each linked set in it, never all pairs. Buckets over a size are cut into blocks and every two
blocks are compared in a task of their own. Components come from alternating large-star and small-star steps, each of
them joins and aggregations on node ids, written to the shared folder; nothing is gathered in the driver.

Edge cases: null and empty texts have fingerprint zero and link like any other; a null doc_id is never a component's
name (a component of nulls alone has a null id); repeated rows each get a row; only doc_id and text are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise, runs, sliced, text_buffers

RADIUS, SHINGLE_WORDS, SEED = 4, 4, 42
#: A bucket with more fingerprints than this is compared block by block.
BUCKET_ROWS = 4096
#: Hashes whose bits are unpacked at once.
PART = 1 << 15

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bit positions are all outside one of them. phi takes
    every non-zero vector about equally often, so each mask has about half of the bits."""
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, phi in enumerate(vectors) if (v & phi).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    data, offsets = text_buffers(column)
    data = FOLD[data]
    starts, ends = runs(~SPACE[data], offsets)
    first = np.searchsorted(starts, offsets)
    # words joined by single spaces, so that a shingle is one slice
    length = ends - starts
    place = np.cumsum(length + 1) - length - 1
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat(place, length) + inner] = data[np.repeat(starts, length) + inner]
    n_words = np.diff(first)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    bound = np.cumsum(counts)
    if not len(bound) or not bound[-1]:
        return np.zeros(len(column), np.uint64)
    number = np.arange(int(bound[-1])) - np.repeat(bound - counts, counts)
    begin = np.repeat(first[:-1], counts) + number
    last = begin + np.repeat(np.minimum(n_words, shingle), counts) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[last] + length[last]).tolist(), strict=True)), np.uint64, int(bound[-1]))
    full = np.flatnonzero(counts)
    begin, set_bits = bound[full] - counts[full], np.zeros((len(full), 64), np.int64)
    for part in range(0, len(h), PART):  # adds up the bits of the documents that this part touches
        bits = np.unpackbits(h[part : part + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.searchsorted(begin, part, "right") - 1, np.searchsorted(begin, part + len(bits))
        set_bits[i:j] += np.add.reduceat(bits, np.maximum(begin[i:j] - part, 0), axis=0, dtype=np.uint32)
    out = np.zeros(len(column), np.uint64)
    out[full] = ((set_bits * 2 > counts[full][:, None]) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp); fp is the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1)).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def stars(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (smallest, other) that span each set of fingerprints linked within this bucket.

    A search from one fingerprint to the next looks only at those that nothing has reached yet."""
    left = np.unique(fps)
    roots, others = [], []
    while len(left) > 1:
        root, frontier, left = left[0], [left[0]], left[1:]
        while frontier and len(left):
            near = np.bitwise_count((left ^ frontier.pop()).view(np.uint64)) <= radius
            if near.any():
                found = left[near].tolist()
                roots += [int(root)] * len(found)
                others += found
                frontier += list(left[near])
                left = left[~near]
    return roots, others


def bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b, of rows (bucket, fp, node) dealt and sorted by bucket: stars of each bucket, by the nodes' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def edges(b: np.ndarray, f: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(b)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(b)]])
            pair = begin[end - begin == 2]
            near = pair[np.bitwise_count((f[pair] ^ f[pair + 1]).view(np.uint64)) <= radius]
            near = near[f[near] != f[near + 1]]
            one, other = [node[near]], [node[near + 1]]
            for i in np.flatnonzero(end - begin > 2):
                x, y = stars(f[begin[i] : end[i]], radius)
                if x:
                    order = np.argsort(f[begin[i] : end[i]], kind="stable") + begin[i]
                    one.append(node[order[np.searchsorted(f[order], np.array(x, np.int64))]])
                    other.append(node[order[np.searchsorted(f[order], np.array(y, np.int64))]])
            one, other = np.concatenate(one), np.concatenate(other)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([old, c.to_numpy()]) for old, c in zip(held, batch.columns, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if last:
                yield edges(*(x[:last] for x in held))
                held = [x[last:].copy() for x in held]
        if len(held[0]):
            yield edges(*held)

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): for distinct fingerprints (fp, node), edges that connect whatever links within the radius connect."""
    tables = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(covering_masks(radius)))))
    buckets = nodes.select(tables.alias("bucket"), "fp", "node")
    sizes = buckets.groupBy("bucket").count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= bucket_rows:
        return bucket_edges(buckets, radius).distinct()
    # each crowded bucket stands for over bucket_rows of the rows, so this table is small beside them
    crowded = materialise(sizes.where(F.col("count") > bucket_rows), "crowded-buckets")
    small = buckets.join(crowded, "bucket", "left_anti")
    blocks = F.ceil(F.col("count") / bucket_rows).cast("int")
    numbered = buckets.join(crowded, "bucket").select("bucket", "fp", "node", blocks.alias("n"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    paired = numbered.select("bucket", "fp", "node", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    large = paired.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "fp", "node")
    return bucket_edges(small, radius).unionByName(bucket_edges(large, radius)).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) with one row for each node b that reaches a smaller one; a is the smallest that it reaches.

    A round is a large-star step (each node sends its larger neighbours to its smallest) and a small-star step (the
    smaller ones too); it ends when no node is on both sides, that is, when the edges are stars."""
    edges = materialise(edges, "edges")
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        # a table of its own: the join with it can be split where u has most of the edges
        least = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = materialise(both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "large-star")
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("m").alias("a"), F.explode(F.array("v", "u")).alias("b")).where("a < b").distinct()
        edges = materialise(small, "small-star")
        if edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return edges
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row. A fingerprint's node is named by its smallest doc_id, so that the name of a
    component is its smallest node; fingerprints without ids get names over all ids (which are below 2^62)."""
    fps = materialise(fingerprints(documents, id_col, text_col), "fingerprints")
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64("fp"), F.lit(1 << 61))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).select("fp", F.coalesce("node", unnamed).alias("node")), "nodes")
    stars_ = components(links(nodes, radius, bucket_rows))
    root = F.coalesce("a", "node")
    membership = nodes.join(stars_, F.col("node") == F.col("b"), "left").select("fp", F.when(root < (1 << 62), root).alias("component_id"))
    return fps.join(materialise(membership, "membership"), "fp").select("doc_id", "fp", "component_id")


def simhash_components(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
