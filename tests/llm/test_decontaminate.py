import re

import pytest

from tidemark.llm import decontaminate as d

from .helpers import CLASHING, ODD, by_id, documents, lower_ascii, read, rows, sha

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, n=10):
    words = lambda t: WORD.findall(lower_ascii(t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return by_id(out)


@pytest.mark.parametrize("most", [d.MAX_WINDOWS, 0])
def test_against_brute_force(spark, small, most, monkeypatch):
    """Broadcast and, with a bound of no windows, the join."""
    monkeypatch.setattr(d.scan, "__defaults__", (d.WINDOW_WORDS, "text", most, d.MAX_WINDOW_BYTES))
    got = rows(d.contamination(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")))
    assert got == brute(read(small, "documents", "doc_id, text"), read(small, "benchmark", "item_id, text"))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.fixture(params=["broadcast", "join"])
def path(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(d.scan, "__defaults__", (d.WINDOW_WORDS, "text", 0, d.MAX_WINDOW_BYTES))


def test_words_decide_where_hashes_collide(spark, path):
    """The Thue-Morse word and its complement have the same polynomial hash modulo 2^64, whatever the odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    bench = spark.createDataFrame([("x", word), ("y", "one two")], "item_id string, text string")
    docs = [(1, other), (2, f"so {word} it"), (3, f"{other} {word} one two"), (4, None)]
    got = rows(d.contamination(documents(spark, [(i, t, None) for i, t in docs]), bench))
    assert got == brute(docs, [("x", word), ("y", "one two")]) and [r[2] for r in got] == [0, 1, 3, 0]


def test_short_items_overlaps_and_odd_rows(spark, path):
    items = [("a", "lazy DOG"), ("b", "one"), ("c", None), (None, "one"), ("d", ""), ("e", ODD[3][1]), ("a", "lazy DOG"), ("f", "café 東京")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = rows(d.contamination(documents(spark, clashing=CLASHING), bench))
    assert got == brute([r[:2] for r in ODD], [i for i in items if i[0] is not None])


def test_removal(spark, path):
    bench = spark.createDataFrame([("a", "brown fox jumps")], "item_id string, text string")
    docs = documents(spark, [(1, "The Brown, fox jumps! on", "en"), (2, "clean", "en"), (3, None, None)], CLASHING)
    assert d.decontaminate(docs, bench, "document").columns == docs.columns
    assert sorted(r.doc_id for r in d.decontaminate(docs, bench, "document").collect()) == [2, 3]
    spans = {r.doc_id: r.text for r in d.decontaminate(docs, bench, "span").collect()}
    assert spans == {1: "The ! on", 2: "clean", 3: None}
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, "other")


def test_empty_tables(spark, path):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert rows(d.contamination(documents(spark), bench)) == brute([r[:2] for r in ODD], [])
    assert rows(d.contamination(documents(spark, []), bench)) == []
