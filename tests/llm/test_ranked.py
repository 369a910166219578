import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ranked

from .helpers import CLASHING, LONG, by_id, documents, lower_ascii, read, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    """Every document against every item, from the definition."""
    held = [(d, Counter(TERM.findall(lower_ascii(t or "")))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        asked, scored = Counter(TERM.findall(lower_ascii(text or ""))), []
        for doc_id, c in held:
            m = 25 + 75 * c.total() * n_docs // length
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored)[:k])]
    return by_id(out)


def test_against_brute_force(spark, small):
    got = rows(ranked.ranked_search(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")))
    assert got == brute(read(small, "documents", "doc_id, text"), read(small, "benchmark", "item_id, text"))


def items(spark, pairs):
    return spark.createDataFrame(pairs, "item_id string, text string")


ODD = [
    (1, None, None), (2, "", "en"), (3, " \n.,;", "en"), (4, "alpha beta gamma", "en"), (4, "alpha beta gamma", "en"), (5, "ALPHA\x00beta_beta-0gamma", None),
    (None, "alpha alpha", "en"), (None, None, None), (6, LONG + "alpha", "la"), (7, "é É naïve alpha 東京", "fr"), (8, "x" * 70_000, None), (4, "delta", "en"),
]
ASKED = [("a", "Alpha beta, alpha"), ("b", None), ("c", ""), ("d", "no such thing"), ("e", "É naïve 東京 x"), ("a", "Alpha beta, alpha"), (None, "delta lorem"), ("f", LONG)]


@pytest.mark.parametrize("k", [1, 2, 10])
def test_odd_rows(spark, k):
    got = rows(ranked.ranked_search(documents(spark, ODD, CLASHING), items(spark, ASKED), k))
    assert got == brute([r[:2] for r in ODD], ASKED, k)


def test_no_documents_or_items(spark):
    assert rows(ranked.ranked_search(documents(spark, []), items(spark, ASKED))) == []
    assert rows(ranked.ranked_search(documents(spark, ODD), items(spark, []))) == []
    assert rows(ranked.ranked_search(documents(spark, ODD), items(spark, [("a", None)]))) == []


def corpus(seed=7, n=3000):
    """Words by a power law, so that some are in most documents, copies in large groups, and a few rare words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.choice((3, 8, 40, 200))))) for i in range(n)]
    docs += [(n + i, "w0 w1 w2 w17 rare0") for i in range(300)] + [(n + 300 + i, f"rare{i % 5} rare{i % 3} w{i}") for i in range(90)]
    asked = [(f"i{j}", " ".join(rng.choices(words, k=6))) for j in range(12)] + [("r", "rare0 rare1 rare2"), ("m", "rare3 rare4 w300 w0"), ("c", "w0 w1"), ("x", "w0")]
    return docs, asked


def test_items_without_a_proof_fall_through_to_lower_tiers(spark, monkeypatch):
    docs, asked = corpus()
    monkeypatch.setattr(ranked, "SHARD_BYTES", 20_000)
    frame = documents(spark, [(*d, None) for d in docs])
    tiers = ((200, 12), (8, 60))
    want = brute(docs, asked)
    assert rows(ranked.ranked_search(frame, items(spark, asked), tiers=tiers)) == want
    vocabulary = sorted({t for _, text in asked for t in text.split()})
    queries = []
    for i, (_, text) in enumerate(asked):
        terms = Counter(vocabulary.index(t) for t in text.split())
        queries.append(ranked.Query(i, np.array(list(terms), np.int64), np.array(list(terms.values()), np.int64)))
    index = ranked.build(frame, vocabulary, tiers=tiers)
    hits, proved = ranked.search(index, queries)
    assert len(proved) == 3 and all(proved), "each tier proves some"
    assert by_id((asked[r["query"]][0], r["rank"], r["id"], r["score"]) for r in hits.collect()) == want
    again, _ = ranked.search(index, queries[:1])
    assert by_id((asked[0][0], r["rank"], r["id"], r["score"]) for r in again.collect()) == [w for w in want if w[0] == "i0"], "an index can be searched again"
    for named in (0, 10**6):
        monkeypatch.setattr(ranked, "NAMED_SHARDS", named)
        assert ranked.search(index, queries)[1] == proved


def test_tiers_cut_each_terms_postings_by_impact(spark):
    docs, _ = corpus(n=2000)
    index = ranked.build(documents(spark, [(*d, None) for d in docs]), ["w0", "w1", "rare3"], tiers=((50, 10), (5, 100)))
    for t in range(3):
        held = [(w, r[f"impacts{t}"][i]) for r in index.shards.collect() for i, w in enumerate(np.repeat(r[f"terms{t}"], r[f"counts{t}"]))]
        for term in range(3):
            own = [x for w, x in held if w == term]
            if t < 2 and own:
                assert min(own) > index.bounds[t][term]
    assert [index.bounds[i][2] for i in range(2)] == [max(0, index.bounds[0][2]), 0], "a rare term is whole in the upper tiers"


def test_blocks_of_queries_give_the_same(spark, small):
    docs, asked = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet").limit(12)
    assert rows(ranked.ranked_search(docs, asked, most=150)) == rows(ranked.ranked_search(docs, asked))


def test_long_texts_are_counted_in_pieces():
    text = "Ab cd é" * 50 + " " + "x" * 100 + "-end"
    assert all(ranked.count_terms(text, most) == ranked.count_terms(text) for most in (1, 7, 64, 99))
