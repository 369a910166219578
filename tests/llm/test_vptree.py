import numpy as np
import pytest

from tidemark.llm import vptree

from .helpers import read


def brute(ids, vectors, wanted, k=20):
    out = {}
    for q in wanted:
        i = list(ids).index(q)
        score = (vectors * vectors[i]).sum(axis=1)
        order = np.lexsort((ids, -score))
        out[q] = [(int(ids[j]), float(score[j])) for j in order if ids[j] != q][:k]
    return out


@pytest.fixture(scope="module")
def table(small):
    rows = read(small, "embeddings", "vec_id, embedding")
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_of_the_query(spark, small, table):
    ids, vectors = table
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0])
    got = by_query(vptree.every_20th(spark.read.parquet(f"{small}/embeddings.parquet")))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found / sum(map(len, want.values())) >= 0.9
    for q, rows in got.items():
        for i, s in rows:
            assert s == pytest.approx((vectors[list(ids).index(i)] * vectors[list(ids).index(q)]).sum(), abs=1e-9)


def test_factor_one_is_exact(spark, small, table):
    ids, vectors = table
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = by_query(vptree.nearest(df, df.where("vec_id % 50 = 0"), factor=1.0))
    want = brute(ids, vectors, [i for i in ids if i % 50 == 0])
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def scanned(tree, queries):
    """Share of the points that a query is compared with, and the numbers found."""
    scan, seen = tree._scan, []
    tree._scan = lambda at, who: (seen.append(len(at) * len(who)), scan(at, who))[1]
    best, _ = tree.search(queries)
    return sum(seen) / len(queries) / len(tree.points), best


def test_pruning_is_by_the_factor():
    points = np.random.default_rng(1).standard_normal((4000, 3))
    shares = [scanned(vptree.Tree(points, np.arange(len(points)), 5, factor, leaf=32), points[:50])[0] for factor in (1.0, 3.0)]
    assert shares[1] < shares[0] < 0.6


@pytest.mark.parametrize("dimensions, spread, most", [(16, 0, 0.35), (32, 0, 0.5), (64, 0.15, 0.4)])
def test_recall_and_share_of_large_shards(dimensions, spread, most):
    """Vectors of unequal norms, and jittered unit vectors about 500 centres, in one shard of 20000 rows."""
    rng = np.random.default_rng(0)
    if spread:
        points = rng.standard_normal((500, dimensions))[rng.integers(0, 500, 20_000)] + spread * rng.standard_normal((20_000, dimensions))
        points /= np.linalg.norm(points, axis=1)[:, None]
    else:
        points = rng.standard_normal((20_000, dimensions)) * rng.uniform(0.3, 2, (20_000, 1))
    queries = points[::200]
    tree = vptree.Tree(points, np.arange(len(points)), 20, vptree.FACTOR)
    share, best = scanned(tree, queries)
    want = np.argsort(-(queries @ tree.points.T), axis=1, kind="stable")[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(want.tolist(), best.tolist())]) >= 0.95
    assert share <= most


def test_factor_one_loses_no_close_copy():
    """Distances that differ by roundings: every pair of the exact ranking that is told apart at 1e-12 is found."""
    rng = np.random.default_rng(4)
    points = np.repeat(rng.standard_normal((60, 24)), 50, axis=0) + 10.0 ** rng.uniform(-9, -3, (3000, 1)) * rng.standard_normal((3000, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = vptree.Tree(points, np.arange(len(points)), 20, 1.0)
    best, score = tree.search(points[:300])
    exact = np.sort(points[:300] @ tree.points.T, axis=1)[:, ::-1][:, :21]
    assert np.abs(score - exact).max() < 1e-12


def test_shards_follow_the_rows():
    assert [vptree.shards_of(n) for n in (0, 2000, 10_260, 51_300, 1 << 20, 1 << 26)] == [1, 1, 5, 16, 16, 1024]


def test_two_vectors_of_one_id(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert by_query(vptree.every_20th(df)) == {20: [(2, 3.0), (1, 2.0), (2, 0.0)]}


def test_odd_rows(spark):
    v = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (60, [0.0, 1.0]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in v], "vec_id long, embedding array<double>, score int")
    got = by_query(vptree.every_20th(df))
    assert got == {20: [(1, 1.0), (2, 1.0), (60, 0.0), (10, -1.0)], 60: [(10, 0.5), (1, 0.0), (2, 0.0), (20, 0.0)]}
    assert vptree.every_20th(df.limit(0)).count() == 0


def test_crowds_of_equal_vectors(spark):
    df = spark.range(2000).selectExpr("id AS vec_id", "array(1d, double(id % 2)) AS embedding")
    got = by_query(vptree.nearest(df, df.where("vec_id IN (0, 21)"), k=3))
    assert [i for i, _ in got[0]] == [1, 2, 3] and [i for i, _ in got[21]] == [1, 3, 5]


def test_shards_are_bounded_in_bytes(spark):
    """Wide vectors make more and smaller shards, and the same neighbours."""
    assert vptree.rows_within(vptree.SHARD_BYTES, 64) == vptree.SHARD_ROWS and vptree.rows_within(vptree.SHARD_BYTES, 4096) == 1024 and vptree.rows_within(8, 100) == 1
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=512)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, vptree.every_20th(df).collect()))
    before = vptree.SHARD_BYTES, vptree.QUERY_BYTES
    vptree.SHARD_BYTES, vptree.QUERY_BYTES = 40 * 512 * 8, 3 * 512 * 8
    try:
        assert sorted(map(tuple, vptree.nearest(df, df.where("vec_id % 20 = 0"), factor=1.0).collect())) == sorted(map(tuple, vptree.nearest(df, df.where("vec_id % 20 = 0"), factor=1.0, shard_rows=1 << 16).collect()))
        got = sorted(map(tuple, vptree.nearest(df, df.where("vec_id % 20 = 0"), factor=1.0).collect()))
    finally:
        vptree.SHARD_BYTES, vptree.QUERY_BYTES = before
    exact = np.array([r[1] for r in rows])
    scores = exact[::20] @ exact.T
    for q, row in zip(range(0, 300, 20), scores):
        row[q] = -np.inf
        assert [r[2] for r in got if r[0] == q] == np.argsort(-row)[:20].tolist()
    assert len(want) == len(got) == 300
