"""A Merkle manifest of a dataset: one root for all rows, a subroot for each source, and a proof for each row.

Each row is a leaf, H of its fields; H is SHA-256, and digests are hashed as lowercase hex text. Leaves of a source ascend
by id; while a tree has more than one node, every ARITY consecutive nodes (the last run may be shorter, even one) become
their H, up to the subroot; the subroots, ordered by source (null first, UTF-8 bytewise), become the root in the same way.

Supersteps over RDDs, as in Pregel. A vertex is (tree, index); a tree is named by the position of its first leaf in the
order of all leaves, which sorts trees as their sources. Upwards, nodes message their parents, and a parent that has all its
children hashes them, keeps their digests and messages on. Downwards, each vertex gets the siblings on the path from it to
the root and sends each child that path, the child's own siblings before it. The leaf folds its path into a root again.
STRIDE levels of vertices over ARITY ** STRIDE neighbouring nodes are a block and live together: what they message each
other needs no shuffle, so that a superstep climbs or descends STRIDE levels.

Scale: leaves are hashed where the text is (DataFrame functions) and only digests move on. Leaves are ordered by range
partitions of (source, id, digest, row), so that a source with any share of the rows is cut; positions come from the sizes
and edge sources of the partitions alone, two for each, which is all that reaches the driver besides the root. Paths are
never sent to leaves: they are made in the blocks of the leaves, which get one path each. Partitions follow the nodes of a
level. The order of the leaves and the subroots are checkpointed; supersteps between them rest on their shuffle files, and a
lost executor's part of these is made again from the checkpoint, a few steps away.

Edge cases: a null field is '-'; rows with a null id come first within their source; rows of equal (source, id) are ordered
by digest, and equal rows each get a leaf and a result; a source of one row has its leaf as subroot; one source has its
subroot as root; an empty table has no root and no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialise, shared_dir

ARITY = 3
#: Levels in a block.
STRIDE = 4
#: Nodes of a level in one partition.
VERTICES = 40_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """'-' for null, else the size in bytes, a colon and the value, as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of all fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(f) for f in fields)).cast("binary"), 256))


def combined(digests: Iterable[bytes]) -> bytes:
    """H of nodes in a run."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def steps(index: int, count: int, arity: int) -> Iterator[tuple[int, int]]:
    """Place within its run and number of siblings of a leaf's ancestors, from the leaf up, in a tree of count leaves."""
    while count > 1:
        yield index % arity, min(arity, count - index // arity * arity) - 1
        index, count = index // arity, -(-count // arity)


def fold(digest: bytes, path: bytes, *trees: tuple[int, int], arity: int = ARITY) -> bytes:
    """The root that a leaf and the siblings on its path give; trees are (index, count) of the leaf's own tree and of those
    above it."""
    at = 0
    for index, count in trees:
        for place, others in steps(index, count, arity):
            run = [path[i : i + 32] for i in range(at, at + 32 * others, 32)]
            run.insert(place, digest)
            digest, at = combined(run), at + 32 * others
    return digest


def _saved(rdd: RDD) -> RDD:
    """The RDD, checkpointed in the shared folder; it is kept on disk until the checkpoint has read it."""
    rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    rdd.count()
    rdd.unpersist()
    return rdd


def _parts(vertices: int) -> int:
    return 1 + vertices // VERTICES


def climbed(digests: list[bytes], whole: bool, arity: int) -> list[list[bytes]]:
    """The levels over consecutive nodes: STRIDE of them, or, over a whole tree's nodes, up to the one that is left."""
    levels = [digests]
    while len(levels[-1]) > 1 if whole else len(levels) <= STRIDE:
        below = levels[-1]
        levels.append([combined(below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


class Forest:
    """Trees that have been climbed: the blocks of each superstep, of which the last has the roots.

    leaves: RDD of ((tree, index), (count of the tree's leaves, digest, what the leaf carries)); size: how many there are;
    largest: leaves of the largest tree. A tree that is done passes its root on as it is."""

    def __init__(self, leaves: RDD, size: int, largest: int, arity: int = ARITY):
        self.arity, self.width = arity, arity**STRIDE
        self.rounds: list[RDD] = []
        self.parts: list[int] = []
        nodes = leaves
        while not self.rounds or largest > self.width ** len(self.rounds):
            self.parts.append(_parts(-(-size // self.width ** len(self.rounds))))
            self.rounds.append(self._superstep(nodes, self.parts[-1], len(self.rounds)))
            nodes = self.rounds[-1].map(lambda x: (x[0], (*x[1][:2], None)))
        #: ((tree, 0), (count of its leaves, digest of its root, None))
        self.roots = nodes

    def _superstep(self, nodes: RDD, parts: int, before: int) -> RDD:
        """((tree, block), (count, digest, nodes)) of all blocks; nodes is None for a tree that was done before."""
        arity, width, below = self.arity, self.width, self.width**before

        def message(node):
            (tree, index), (count, digest, carried) = node
            return (tree, index // width), (index % width, count, digest, carried)

        def gather(messages):
            inbox: dict = {}
            for (tree, block), (place, count, digest, carried) in messages:
                if before and count <= below:
                    yield (tree, block), (count, digest, None)
                    continue
                size = min(width, -(-count // below) - width * block)
                children = inbox.setdefault((tree, block), {})
                children[place] = (digest, carried)
                if len(children) == size:  # all are there: the block climbs and sends on what it comes to
                    own = [children[i] for i in range(size)]
                    del inbox[tree, block]
                    yield (tree, block), (count, climbed([d for d, _ in own], count <= below * width, arity)[-1][0], own)
            if inbox:
                raise RuntimeError(f"{len(inbox)} blocks lack nodes")

        return nodes.map(message).partitionBy(parts).mapPartitions(gather, True)

    def descend(self, inbox: RDD) -> RDD:
        """(what the leaf carries, its digest, index, path, what its tree was sent) of every leaf. inbox: ((tree, 0), (path
        above the tree's root, what all its leaves shall know)). A path is the siblings' digests joined."""
        arity, width = self.arity, self.width

        def forward(below):
            def run(rows):
                for (tree, block), (count, digest, own), (path, known) in _met(rows):
                    if own is None:
                        yield (tree, block), (path, known), None
                        continue
                    levels = climbed([d for d, _ in own], count <= below * width, arity)
                    for i, (digest, carried) in enumerate(own):
                        siblings, at = [], i
                        for level in levels[:-1]:
                            start = at - at % arity
                            siblings += [*level[start:at], *level[at + 1 : start + arity]]
                            at //= arity
                        yield (tree, block * width + i), (b"".join(siblings) + path, known), (carried, digest)

            return run

        for r in range(len(self.rounds) - 1, -1, -1):
            # only the messages move where the blocks still have their partitions
            met = self.rounds[r].union(inbox.partitionBy(self.parts[r])).partitionBy(self.parts[r]).mapPartitions(forward(width**r))
            inbox = met.map(lambda x: x[:2])
        return met.map(lambda x: (*x[2], x[0][1], *x[1]))


def _met(rows: Iterable) -> Iterator[tuple]:
    """(key, vertex, message) of rows that hold a vertex, of three parts, and a message, of two, for each key."""
    waiting: dict = {}
    for key, value in rows:
        other = waiting.pop(key, None)
        if other is None:
            waiting[key] = value
        else:
            yield (key, value, other) if len(value) == 3 else (key, other, value)
    if waiting:
        raise RuntimeError(f"{len(waiting)} vertices or messages have no partner")


class Manifest(NamedTuple):
    """Of a dataset: the root (32 bytes, None without rows), the number of rows and of trees, and the trees themselves."""

    root: bytes | None
    rows: int
    trees: int
    leaves: Forest | None
    top: Forest | None

    def proofs(self) -> RDD:
        """(what the leaf carries, its digest, (index, count) of its own tree and of the top tree, subroot, path)."""
        trees = self.trees
        tops = self.top.descend(self.top.roots.map(lambda x: (x[0], (b"", ()))))
        inbox = tops.map(lambda x: ((x[0][0], 0), (x[3], (x[1], x[2], x[0][1]))))
        return self.leaves.descend(inbox).map(lambda x: (x[0], x[1], (x[2], x[4][2]), (x[4][1], trees), x[4][0], x[3]))

    def verified(self) -> RDD:
        """Rows of RESULT. A leaf carries its id and the digest of the row as it is now, None where that is the leaf."""
        root, arity = self.root, self.leaves.arity

        def verify(proof):
            (doc_id, now), leaf, own, top, subroot, path = proof
            folded = fold(now or leaf, path, own, top, arity=arity)
            return doc_id, leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(path.hex().encode()).hexdigest(), folded.hex(), folded == root

        return self.proofs().map(verify)


def _positions(ordered: RDD) -> tuple[RDD, int, int, int]:
    """((tree, index), (count, digest, carried)) of rows (source, doc_id, leaf, now), which are in order of their sources; the
    number of rows and of trees, and the rows of the largest tree."""

    def runs(part, rows):
        n, trees, most, first, last = 0, 0, 0, None, None
        for row in rows:
            if last is None or row[0] != last[0]:
                last, trees = [row[0], 0, n], trees + 1
                first = first or last
            last[1] += 1
            n, most = n + 1, max(most, last[1])
        yield part, n, trees, most, [] if first is None else [first] if first is last else [first, last]

    start: dict = {}
    total: dict = {}
    offsets, at, trees, largest = {}, 0, 0, 0
    # two sources of each partition at most, whatever the rows
    for part, n, own, most, edges in sorted(ordered.mapPartitionsWithIndex(runs).collect()):
        offsets[part] = at
        trees, largest = trees + own, max(largest, most)
        for k, (source, count, before) in enumerate(edges):
            if k == 0 and source in total:
                trees -= 1
            start.setdefault(source, at + before)
            total[source] = total.get(source, 0) + count
        at += n
    largest = max([largest, *total.values()])

    def placed(part, rows):
        at, run = offsets[part], []

        def out():
            tree, count = start.get(run[0][0], at), total.get(run[0][0], len(run))
            for i, (_, doc_id, leaf, now) in enumerate(run):
                yield (tree, at + i - tree), (count, bytes(leaf), (doc_id, None if now is None else bytes(now)))

        for row in rows:
            if run and run[0][0] != row[0]:
                yield from out()
                at, run = at + len(run), []
            run.append(row)
        if run:
            yield from out()

    return ordered.mapPartitionsWithIndex(placed), at, trees, largest


def build(leaves: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of rows (source, doc_id, leaf, now)."""
    spark = leaves.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    rows = materialise(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    parts = _parts(rows.count())
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("source", "doc_id", "leaf", "now")
    ordered = _saved(ordered.rdd.map(tuple))
    nodes, n, trees, largest = _positions(ordered)
    if not n:
        return Manifest(None, 0, 0, None, None)
    forest = Forest(nodes, n, largest, arity)
    ranked = forest.roots.map(lambda x: (x[0][0], x[1][:2])).sortByKey(numPartitions=_parts(trees)).zipWithIndex()
    # one tree of all subroots; each carries its tree's name and count
    subroots = _saved(ranked.map(lambda x: ((0, x[1]), (trees, x[0][1][1], (x[0][0], x[0][1][0])))))
    top = Forest(subroots, trees, trees, arity)
    ((_, (_, root, _)),) = top.roots.collect()  # one row
    return Manifest(root, n, trees, forest, top)


def manifest_rows(documents: DataFrame, now_col: str = "text") -> DataFrame:
    """RESULT of documents, each leaf against the row with now_col in place of text."""
    spark: SparkSession = documents.sparkSession
    fields = [F.col(c) for c in FIELDS]
    leaf, now = leaf_digest(fields), leaf_digest([*fields[:-1], F.col(now_col)])
    same = F.col("text").eqNullSafe(F.col(now_col))
    built = build(documents.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), F.when(~same, now).alias("now")))
    return spark.createDataFrame(built.verified() if built.rows else [], RESULT, verifySchema=False)


def tampered(documents: DataFrame) -> DataFrame:
    """documents with `now`: the text, without its line feeds where 2 divides the CRC-32 of the id."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return documents.select(*FIELDS, F.when(struck, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")).alias("now"))


def merkle_manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; what is verified is the tampered document."""
    return manifest_rows(tampered(documents), "now")


# crc32(s): bit by bit, as SQL has no function for it
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), fields AS (
  SELECT d.*, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents d LEFT JOIN bits b USING (doc_id)
), digests AS (
  SELECT doc_id, source, h AS fixed, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(h || coalesce(strlen(now) || ':' || now, '-')) AS now
  FROM (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS h FROM fields)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM digests
), nodes AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
), runs AS (
  SELECT source, level, idx // 3 AS run, list(digest ORDER BY idx) AS digests FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, idx // 3 AS run, list(digest ORDER BY idx) AS digests FROM tops WHERE n > 1 GROUP BY ALL
), up AS (
  SELECT doc_id, leaf, source, idx AS first, 0 AS level, idx, n, now AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, leaf, u.source, first, u.level + 1, idx // 3, (n + 2) // 3,
    sha256(array_to_string(list_concat(digests[1:idx % 3], [folded], digests[idx % 3 + 2:]), '')),
    proof || array_to_string(list_concat(digests[1:idx % 3], digests[idx % 3 + 2:]), '')
  FROM up u JOIN runs r ON u.source IS NOT DISTINCT FROM r.source AND u.level = r.level AND u.idx // 3 = r.run WHERE n > 1
), over AS (
  SELECT u.doc_id, u.leaf, s.subroot, u.source, u.first, 0 AS level, s.idx, s.n, u.folded, u.proof FROM up u JOIN subroots s ON u.source IS NOT DISTINCT FROM s.source WHERE u.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, source, first, o.level + 1, idx // 3, (n + 2) // 3,
    sha256(array_to_string(list_concat(digests[1:idx % 3], [folded], digests[idx % 3 + 2:]), '')),
    proof || array_to_string(list_concat(digests[1:idx % 3], digests[idx % 3 + 2:]), '')
  FROM over o JOIN top_runs r ON o.level = r.level AND o.idx // 3 = r.run WHERE n > 1
)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified
FROM over o CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t WHERE o.n = 1
"""
