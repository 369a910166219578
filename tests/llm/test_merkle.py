import hashlib
import zlib

import pytest

from tidemark.llm import merkle

from .helpers import CLASHING, by_id, read, rows

FIELDS = "doc_id, source, lang, n_chars, text"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i // 3 * 3
        yield i - start, [x for j, x in enumerate(level[start : start + 3]) if j != i - start]
        i //= 3


def brute(docs):
    """Recursion-free and level by level, over lists in memory."""
    by_source = {}
    for row in docs:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, climb([leaf(r) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    root, out = top[-1][0], []
    for t, (own, levels) in enumerate(trees):
        for i, row in enumerate(own):
            path = [*siblings(levels, i), *siblings(top, t)]
            doc_id, text = row[0], row[4]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now = leaf((*row[:4], text))
            for place, others in path:
                now = h([*others[:place], now, *others[place:]])
            out.append((doc_id, leaf(row), levels[-1][0], root, h(x for _, others in path for x in others), now, now == root))
    return by_id(out)


def frame(spark, docs, clashing=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    return df.withColumns({c: F.lit("own") for c in clashing}) if clashing else df


def test_against_brute_force(spark, small):
    got = rows(merkle.merkle_manifest(spark.read.parquet(f"{small}/documents.parquet")))
    assert got == brute(read(small, "documents", FIELDS))
    assert {r[-1] for r in got} == {True, False}


ODD = [
    (None, None, None, None, None),
    (1, None, None, 0, ""),
    (2, "a", "en", 3, "x\ny"),
    (2, "a", "en", 3, "x\ny"),
    (2, "a", "en", 4, "x\nz\n"),
    (None, "a", "en", 4, "x\nz\n"),
    (3, "é", "fr", 1, "é"),
    (4, "z", "fr", None, "\n" * 1000),
    (5, "Z", "", -7, "word " * 50_000),
    (6, "", "en", 1, "\x00"),
]


@pytest.mark.parametrize("docs", [ODD, ODD[:1], ODD[2:3], ODD[2:5], [(i, "one", "en", 1, f"{i}\n") for i in range(10)], [(i, f"s{i}", None, 1, "\n") for i in range(28)]])
def test_odd_tables(spark, docs):
    assert rows(merkle.merkle_manifest(frame(spark, docs, ("now", "leaf", "row", "root", "Text_")))) == brute(docs)


def test_no_rows(spark):
    out = merkle.merkle_manifest(frame(spark, []))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_any_cut_of_the_order_gives_the_same(spark, small, monkeypatch):
    """Many small partitions: sources over several of them, several sources in one, a hot source, equal rows."""
    docs = [(i % 90, "hot" if i % 3 else f"s{i % 7}", "en", i % 90, f"text {i % 90}\n") for i in range(400)]
    monkeypatch.setattr(merkle, "VERTICES", 9)
    assert rows(merkle.merkle_manifest(frame(spark, docs, CLASHING))) == brute(docs)


def test_a_changed_row_is_told(spark):
    docs = [(i, f"s{i % 4}", "en", 1, f"text {i}") for i in range(50)]
    from pyspark.sql import functions as F

    changed = frame(spark, docs).withColumn("now", F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text")))
    assert [r.doc_id for r in merkle.manifest_rows(changed, "now").where("NOT verified").collect()] == [17]
