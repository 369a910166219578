"""Ranked lexical search over a tiered index.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With N documents that have
terms, L terms in all, n in a document, df documents that hold a term and tf occurrences, a posting's impact is
(1000000000 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L, and a document's score the sum of weight times impact over a
query's terms with repeats, the weight being floor(1000 ln((2N + 2) / (2 df + 1))). All but the weight is 64-bit integer.

The index holds a row for each shard of documents; its columns are tiers. The first tier has a term's postings of the
highest impacts, one in TIERS[0][0] of them and TIERS[0][1] at least, the next tier those down to a larger share, the last
one the rest; ties of impact stay together. What a tier and those above leave out of a term has a bound, the highest impact
below. A search scores tier by tier:

- With the postings so far, each document has a score that it reaches at least; theta is the k-th best of a query.
- A document that none of them names reaches the sum of weight times bound at the most. Where that is below theta, no such
  document can be among the k best: the query is proven. Documents whose own bound reaches theta are its candidates; what
  they miss is read from their shards' lower tiers, which makes their scores exact.
- Queries that lack the proof fall through to the next tier; the last one has every posting and needs none.

Scale: a task turns its documents into shards of about SHARD_BYTES of text, so postings are never shuffled and a common
term has some in every shard; only counts by term and by (term, impact bin) meet. Parquet reads the tiers that a pass asks
for, and lower tiers only of shards that hold candidates. A task keeps k results of each query, so what meets afterwards is
k x tasks rows a query, of which Spark's limit by group keeps k before they are shuffled. The vocabulary of the queries is
broadcast to tasks; queries are taken in blocks with at most QUERY_TERMS different terms each, and every block reads the
documents once: the bound holds for any number of queries. An index with a vocabulary of its own can be kept and searched
again.

Edge cases: null and empty texts have no terms; rows with equal ids are documents of their own, and so are equal queries;
equal scores are ranked by id, null ids last; without documents or terms there are no results; very long texts are counted
in pieces; only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialise

K = 10
#: A tier reaches down to one in so many of a term's postings, and to so many at least; the last tier has all the rest.
TIERS = ((64, 1_000), (8, 8_000))
#: Width of the bins of impacts, of which there are 245 at the most.
BIN = 4096
SHARD_BYTES = 4 << 20
#: Pairs of query and term in a block of queries.
QUERY_TERMS = 200_000
#: As many shards with candidates are named to the reader of the index; beyond, it reads all.
NAMED_SHARDS = 2_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def count_terms(text: str | None, most: int = SHARD_BYTES) -> Counter:
    """Occurrences of each term, as bytes; texts over `most` bytes are counted in pieces."""
    data, at, out = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0, Counter()
    while at < len(data):
        end = at + most
        if end < len(data):
            end = data.rfind(b" ", at, end) if b" " in data[at:end] else data.find(b" ", end)
            end = len(data) if end < 0 else end + 1
        out.update(data[at:end].split())
        at = end
    return out


#: Documents of a shard that hold any of the terms; terms with the number of their postings; place, tf and n by posting.
RAW = "ids array<long>, documents long, length long, terms array<int>, counts array<int>, places array<int>, tf array<int>, n array<int>"


def _ints(values, kind=np.int32) -> pa.Array:
    return pa.array([np.asarray(values, kind)])


def raw_shards(documents: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of RAW with a number, a table of its own."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, term, place, tf, n, documents, length, size = [], [], [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            order = np.argsort(np.asarray(term, np.int32), kind="stable")
            names, counts = np.unique(np.asarray(term, np.int32), return_counts=True)
            parts = [pa.array([ids], pa.list_(pa.int64())), pa.array([documents]), pa.array([length]), _ints(names), _ints(counts)]
            parts += [_ints(np.asarray(x, np.int32)[order]) for x in (place, tf, n)]
            return pa.RecordBatch.from_arrays(parts, [c.split()[0] for c in RAW.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held = count_terms(text := text.as_py())
                size += len(text or "")
                if held:
                    all_terms = held.total()
                    documents, length = documents + 1, length + all_terms
                    found = [(t, c) for w, c in held.items() if (t := known.get(w)) is not None]
                    if found:
                        term += [t for t, _ in found]
                        tf += [c for _, c in found]
                        place += [len(ids)] * len(found)
                        n += [all_terms] * len(found)
                        ids.append(doc_id.as_py())
                if size >= SHARD_BYTES:
                    yield shard()
                    ids, term, place, tf, n, documents, length, size = [], [], [], [], [], 0, 0, 0
        if documents:
            yield shard()

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, RAW)
    return materialise(rows.withColumn("shard", F.monotonically_increasing_id()), "postings")


def _flat(column: pa.Array, i: int, kind=np.int64) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).astype(kind)


class Tier(NamedTuple):
    """Postings of one shard, ordered by term."""

    terms: np.ndarray
    ends: np.ndarray
    places: np.ndarray
    impacts: np.ndarray

    def lists(self, terms: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(i, postings) for each of the terms that has some."""
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            for i in np.flatnonzero(self.terms[at] == terms):
                yield i, slice(self.ends[at[i] - 1] if at[i] else 0, self.ends[at[i]])


class TieredIndex(NamedTuple):
    """shards: a table with a row for each shard. By term: weight, and for each tier but the last the bound of what it and
    those above leave out."""

    spark: SparkSession
    shards: DataFrame
    vocabulary: dict[bytes, int]
    weights: np.ndarray
    bounds: list[np.ndarray]

    @property
    def tiers(self) -> int:
        return len(self.bounds) + 1


def tier_columns(first: int, last: int) -> list[str]:
    return [f"{c}{t}" for t in range(first, last) for c in ("terms", "counts", "places", "impacts")]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    # n N may pass 64 bits where neither does, so the quotient is taken in Python's integers, once for each n
    sizes, at = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * int(x) * documents // length for x in sizes], np.int64)[at]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build(documents: DataFrame, vocabulary: Sequence[str], id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[tuple[int, int]] = TIERS) -> TieredIndex:
    """The index of all documents for the terms of a vocabulary."""
    spark = documents.sparkSession
    known = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(vocabulary)}
    raw = raw_shards(documents, known, id_col, text_col)
    total = raw.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("l")).first()
    n, length = total.n, total.l

    def bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, counts, tf, size = (_flat(batch.column(c), i) for c in range(4))
                x = impacts(tf, size, n, length)
                key = np.repeat(terms, counts) * 256 + x // BIN
                keys, at, held = np.unique(key, return_inverse=True, return_counts=True)
                top = np.zeros(len(keys), np.int64)
                np.maximum.at(top, at, x)
                yield pa.RecordBatch.from_arrays([pa.array((keys // 256).astype(np.int32)), pa.array((keys % 256).astype(np.int32)), pa.array(held), pa.array(top)], ["term", "bin", "held", "top"])

    # at most 245 rows a term, so a window by term is no hot group
    binned = raw.select("terms", "counts", "tf", "n").mapInArrow(bins, "term int, bin int, held long, top long").groupBy("term", "bin").agg(F.sum("held").alias("held"), F.max("top").alias("top"))
    by_term = Window.partitionBy("term")
    before = F.coalesce(F.sum("held").over(by_term.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = binned.select("term", "bin", "held", "top", F.sum("held").over(by_term).alias("df"), before.alias("before"))
    above = [F.col("before") < F.greatest(F.lit(least), F.col("df") / share) for share, least in tiers]
    cuts = [F.coalesce(F.min(F.when(a, F.col("bin"))), F.lit(0)).alias(f"cut{i}") for i, a in enumerate(above)]
    left = [F.coalesce(F.max(F.when(~a, F.col("top"))), F.lit(0)).alias(f"bound{i}") for i, a in enumerate(above)]
    # one row a term of the vocabulary
    found = binned.groupBy("term").agg(F.max("df").alias("df"), *cuts, *left).collect()
    weights = np.zeros(len(known), np.int64)
    cut, bounds = ([np.zeros(len(known), np.int64) for _ in tiers] for _ in range(2))
    for r in found:
        weights[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
        for i in range(len(tiers)):
            cut[i][r.term], bounds[i][r.term] = r[f"cut{i}"], r[f"bound{i}"]

    columns = tier_columns(0, len(cut) + 1)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, counts, places, tf, size = (_flat(batch.column(c), i) for c in range(2, 7))
                x, term = impacts(tf, size, n, length), np.repeat(terms, counts)
                tier = sum((x // BIN < c[term]).astype(np.int64) for c in cut)
                parts = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1)]
                for t in range(len(cut) + 1):
                    own = tier == t
                    names, held = np.unique(term[own], return_counts=True)
                    parts += [_ints(names), _ints(held), _ints(places[own]), _ints(x[own])]
                yield pa.RecordBatch.from_arrays(parts, ["shard", "ids", *columns])

    schema = "shard long, ids array<long>, " + ", ".join(f"{c} array<int>" for c in columns)
    shards = raw.select("shard", "ids", "terms", "counts", "places", "tf", "n").mapInArrow(split, schema)
    return TieredIndex(spark, materialise(shards, "tiers"), known, weights, bounds)


class Query(NamedTuple):
    number: int
    terms: np.ndarray
    times: np.ndarray


class _Best:
    """The k best of a query's documents so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at):
            s, i, o = np.concatenate([self.scores, scores[at]]), np.concatenate([self.ids, ids[at]]), np.concatenate([self.null, null[at]])
            if len(s) > self.k:
                order = np.lexsort((i, o, -s))[: self.k]
                s, i, o = s[order], i[order], o[order]
                self.least = int(s[-1])
            self.scores, self.ids, self.null = s, i, o


HIT = "query int, id long, score long"


def _hits(best: dict[int, _Best]) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(b.scores), n, np.int32) for n, b in best.items()] or [np.zeros(0, np.int32)])
    join = lambda name, kind: np.concatenate([getattr(b, name) for b in best.values()] or [np.zeros(0, kind)])
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(join("ids", np.int64), mask=join("null", bool)), pa.array(join("scores", np.int64))], ["query", "id", "score"])


def _tiers(batch: pa.RecordBatch, i: int, first: int, last: int, at: int) -> list[Tier]:
    out = []
    for t in range(last - first):
        terms, counts, places, x = (_flat(batch.column(at + 4 * t + c), i) for c in range(4))
        out.append(Tier(terms, np.cumsum(counts), places, x))
    return out


def _ids(batch: pa.RecordBatch, column: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(column)[i].values
    null = values.is_null().to_numpy(zero_copy_only=False)
    return values.fill_null(0).to_numpy(zero_copy_only=False), null


def _add(tiers: list[Tier], query: Query, weights: np.ndarray, score: np.ndarray, missing: np.ndarray | None = None, bounds: np.ndarray | None = None) -> None:
    """Add to the documents' scores, and take the bounds of the terms seen from what they may miss."""
    for tier in tiers:
        for i, s in tier.lists(query.terms):
            w, places = query.times[i] * weights[query.terms[i]], tier.places[s]
            score[places] += w * tier.impacts[s]
            if missing is not None:
                missing[places] -= w * bounds[query.terms[i]]


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: TieredIndex, queries: list[Query], k: int = K) -> tuple[DataFrame, list[int]]:
    """(query, id, score, rank) of the k best documents of each query, and how many queries each tier proved."""
    spark, results, proved, active = index.spark, [], [], queries
    weights = index.weights
    for tier in range(1, index.tiers + 1):
        last = tier == index.tiers
        shared = spark.sparkContext.broadcast(active)

        def best(batches: Iterable[pa.RecordBatch], shared=shared, tier=tier) -> Iterator[pa.RecordBatch]:
            found = {q.number: _Best(k) for q in shared.value}
            for batch in batches:
                for i in range(batch.num_rows):
                    (ids, null), tiers = _ids(batch, 0, i), _tiers(batch, i, 0, tier, 1)
                    for q in shared.value:
                        score = np.zeros(len(ids), np.int64)
                        _add(tiers, q, weights, score)
                        found[q.number].offer(score, ids, null)
            yield _hits(found)

        top = materialise(_ranked(index.shards.select("ids", *tier_columns(0, tier)).mapInArrow(best, HIT), k), "hits")
        if last:
            proved.append(len(active))
            results.append((top, {q.number for q in active}))
            break
        # two numbers a query of the block
        thetas = {r["query"]: r.theta for r in top.groupBy("query").agg(F.min("score").alias("theta"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        rest = {q.number: int((q.times * weights[q.terms] * index.bounds[tier - 1][q.terms]).sum()) for q in active}
        whole = {n for n, r in rest.items() if r == 0}  # nothing is left out of their terms
        proven = [q for q in active if q.number not in whole and rest[q.number] < thetas.get(q.number, 0)]
        proved.append(len(whole) + len(proven))
        if whole:
            results.append((top, whole))
        if proven:
            results.append((_completed(index, proven, thetas, rest, tier, k), {q.number for q in proven}))
        done = whole | {q.number for q in proven}
        active = [q for q in active if q.number not in done]
        if not active:
            break
    parts = [df.where(F.col("query").isin(sorted(of))) if len(of) <= 1000 else df.join(F.broadcast(spark.createDataFrame([(n,) for n in of], "query int")), "query") for df, of in results]
    return reduce(DataFrame.unionByName, parts), proved


def _completed(index: TieredIndex, queries: list[Query], thetas: dict[int, int], rest: dict[int, int], tier: int, k: int) -> DataFrame:
    """Results of proven queries: their candidates with what the lower tiers add."""
    spark, weights, bounds, last = index.spark, index.weights, index.bounds[tier - 1], index.tiers
    shared = spark.sparkContext.broadcast({q.number: q for q in queries})

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, tiers, out = batch.column(1)[i].values, _tiers(batch, i, 0, tier, 2), []
                for n, q in shared.value.items():
                    score, missing = np.zeros(len(ids), np.int64), np.full(len(ids), rest[n], np.int64)
                    _add(tiers, q, weights, score, missing, bounds)
                    places = np.flatnonzero((score > 0) & (score + missing >= thetas[n]))
                    out += [{"query": n, "place": int(p), "score": int(score[p])} for p in places]
                if out:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([out], pa.list_(pa.struct([("query", pa.int32()), ("place", pa.int32()), ("score", pa.int64())])))], ["shard", "found"])

    wanted = materialise(index.shards.select("shard", "ids", *tier_columns(0, tier)).mapInArrow(candidates, "shard long, found array<struct<query:int,place:int,score:long>>"), "candidates")
    named = [r.shard for r in wanted.select("shard").limit(NAMED_SHARDS + 1).collect()]
    shards = index.shards if len(named) > NAMED_SHARDS else index.shards.where(F.col("shard").isin(named))
    joined = shards.select("shard", "ids", *tier_columns(tier, last)).join(wanted, "shard").drop("shard")

    def complete(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(k) for n in shared.value}
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, null), tiers = _ids(batch, 0, i), _tiers(batch, i, tier, last, 1)
                found = batch.column(batch.num_columns - 1)[i].values
                number, place, score = (found.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                for n in np.unique(number).tolist():
                    own = place[number == n]
                    more = np.zeros(len(ids), np.int64)
                    _add(tiers, shared.value[n], weights, more)
                    best[n].offer(more[own] + score[number == n], ids[own], null[own])
        yield _hits(best)

    return materialise(_ranked(joined.mapInArrow(complete, HIT), k), "hits")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = K, tiers: Sequence[tuple[int, int]] = TIERS, most: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text)."""
    spark = documents.sparkSession
    rows = materialise(items.select("item_id", F.col("text").alias("text")).withColumn("row", F.monotonically_increasing_id()), "items")
    pairs = materialise(rows.select("row", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count("*").alias("times")), "query-terms")
    blocks = -(-pairs.count() // most)
    out = []
    for block in range(blocks):
        # QUERY_TERMS rows or thereabouts, dealt by hash
        own = pairs.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()
        vocabulary = sorted({r.term for r in own})
        number = {w: i for i, w in enumerate(vocabulary)}
        by_row: dict[int, list] = {}
        for r in own:
            by_row.setdefault(r.row, []).append((number[r.term], r.times))
        queries = [Query(i, np.array([t for t, _ in terms], np.int64), np.array([c for _, c in terms], np.int64)) for i, terms in enumerate(by_row.values())]
        hits, _ = search(build(documents, vocabulary, tiers=tiers), queries, k)
        out.append(hits.join(spark.createDataFrame(list(enumerate(by_row)), "query int, row long"), "query").select("row", "rank", F.col("id").alias("doc_id"), "score"))
    found = reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "row long, rank int, doc_id long, score long")
    return found.join(rows.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, sum(n)::HUGEINT AS length FROM sizes
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
