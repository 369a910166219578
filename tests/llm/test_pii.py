import re

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import pii

from .helpers import CLASHING, ODD, documents, read, sha

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, rule in RULES.items() for m in re.finditer(rule, text or "") if holds(k, m[0])]


def check(got, texts):
    for r in got:
        base = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in RULES]
        assert r.base_sha256 == sha(",".join(base))
        spans = r.spans.split(",") if r.spans else []
        assert spans[: len(base)] == base and all(s.startswith("term:") for s in spans[len(base) :])
        assert len(spans) - len(base) == r.n_term


def test_against_brute_force(spark, small):
    got = pii.personal_data(spark.read.parquet(f"{small}/documents.parquet")).collect()
    texts = dict(read(small, "documents", "doc_id, text"))
    assert len(got) == len(texts)
    check(got, texts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0


TRICKY = ["a@b.com", "x@y", "@", ".", "..", "%", "_", "-", "+", " ", "(", ")", "1.2.3.4", "256.1.1.1", "01.002.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "+49 30 1234567", "+1", "9" * 13, "é", "😀", "\n", "\t", "a", "Z", "0", "12", "٣"]
TEXT = st.lists(st.sampled_from(TRICKY), max_size=14).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(TEXT, min_size=60, max_size=60))
def test_tricky_texts(spark, texts):
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    check(pii.personal_data(docs).collect(), dict(enumerate(texts)))


def test_odd_rows(spark):
    dense = ("mail a.b@c.de or 10.0.0.1, " * 3000).strip()
    docs = [*ODD, (30, dense, "en"), (31, "@" * 50_000, "en"), (32, "1" * 50_000, "en"), (33, "a" * 50_000 + "@", "en"), (34, "+1 " + "2 " * 50_000, "en")]
    got = pii.personal_data(documents(spark, docs, CLASHING)).collect()
    assert len(got) == len(docs)
    texts = {i: t for i, t, _ in docs if i is not None}
    check([r for r in got if r.doc_id is not None], texts)
    assert pii.personal_data(documents(spark, [])).collect() == []


def test_disclosing_terms(spark):
    """A rare name beside an address in several documents gives it away; a word of every document doesn't."""
    docs = [(i, f"please write the Zebulon to zed@corp.example the soonest {i}", "en") for i in range(4)] + [(i, f"the report number {i} was written to the office", "en") for i in range(4, 60)]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, docs)).collect()}
    text = docs[0][1]
    told = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[0].spans.split(",") if s.startswith("term"))}
    assert "Zebulon" in told and "the" not in told and got[10].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(spark, docs)).collect()}
    assert "[EMAIL]" in clean[0] and "zed@" not in clean[0] and "Zebulon" not in clean[0] and clean[10] == docs[10][1]


def test_sanitise_odd_rows(spark):
    out = pii.sanitise(documents(spark, ODD))
    assert sorted((r.doc_id is None, r.text is None) for r in out.collect()) == sorted((r[0] is None, r[1] is None) for r in ODD)


def told_words(row, text):
    return [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in row.spans.split(",") if s.startswith("term"))]


def test_terms_at_a_distance_and_of_rare_entities(spark):
    """A term far from the entity, each of its occurrences, and the term of an entity of a single document."""
    far = "this is an ordinary line of the report " * 3
    docs = [(i, f"Zebulon {far} zed@corp.example {far} ZEBULON and {far} zebulon", "en") for i in range(4)]
    docs += [(4, f"Quentin {far} q.uentin@corp.example {far} quentin", "en"), (5, f"{far} Zebulon and Quentin", "en")]
    docs += [(i, f"{far} and the number {i}", "en") for i in range(6, 400)]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, docs)).collect()}
    for i in range(4):
        assert told_words(got[i], docs[i][1]) == ["Zebulon", "ZEBULON", "zebulon"]
    assert told_words(got[4], docs[4][1]) == ["Quentin", "quentin"]
    assert all(got[i].n_term == 0 for i in range(5, 400))
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(spark, docs)).collect()}
    assert "zebulon" not in clean[0].lower() and "quentin" not in clean[4].lower() and clean[5] == docs[5][1]


def brute_terms(docs, threshold=pii.DISCLOSURE):
    """Spans of disclosing terms by counting over all documents, pair by pair."""
    import math
    from collections import Counter

    low = lambda t: [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
    entities, n_e, n_t, n_et = [], Counter(), Counter(), Counter()
    for _, text in docs:
        own = set()
        for kind, rule in RULES.items():
            own |= {kind + ":" + m[0].lower() for m in re.finditer(rule, text) if holds(kind, m[0])}
        words = {w for w, _, _ in low(text)}
        entities.append(own)
        n_e.update(own)
        n_t.update(words)
        n_et.update((e, w) for e in own for w in words)
    out = {}
    for (doc_id, text), own in zip(docs, entities, strict=True):
        told = set()
        for e in own:
            p = n_e[e] / len(docs)
            if p < 1:
                told |= {w for w, _, _ in low(text) if math.log((n_et[e, w] + pii.PRIOR * p) / ((n_t[w] + pii.PRIOR) * p)) / -math.log(p) >= threshold}
        masked = re.sub(RULES["email"], lambda m: "@" * len(m[0]), text)
        out[doc_id] = [f"term:{a}:{b}" for w, a, b in low(masked) if w in told]
    return out


def test_terms_against_brute_force(spark, small):
    """Whole documents, with entities of one document and of several, that share terms or are hot."""
    docs = [(i, t) for i, t in read(small, "documents", "doc_id, text") if t and all(c.isascii() or c.isalpha() for c in t)]
    docs += [(10_000 + i, f"Team{'ABC'[i % 3]} of Quorl meets ann{i % 5}@corp.example and +49 30 55512{i % 4}0 on day {i}, says {'Zorblat' if i % 5 == 1 else 'nobody'}") for i in range(60)]
    docs += [(20_000 + i, f"hot@corp.example wrote line {i} of it") for i in range(len(docs) // 3)]
    want = brute_terms(docs)
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("term")] for r in pii.personal_data(documents(spark, [(i, t, None) for i, t in docs])).collect()}
    assert got == want and sum(map(bool, want.values())) > 20


def test_long_texts_take_time_in_proportion(spark):
    """200,000 words, half of the different ones told, and as many base spans as a text can hold."""
    import time

    words = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    text = "x@corp.example " + " ".join(("told" if i % 2 else "other") + words(i % 20_000) for i in range(200_000))
    told = [f"told{words(i)}" for i in range(1, 20_000, 2)]
    rows_ = spark.createDataFrame([(1, text, told)], "id int, masked string, told array<string>")
    began = time.perf_counter()
    (row,) = pii._with_occurrences(rows_).select(__import__("pyspark").sql.functions.size("found_terms").alias("n"), "found_terms").collect()
    assert time.perf_counter() - began < 40
    assert row.n == 100_000 and all(text[s.start : s.end].startswith("told") for s in row.found_terms[::997])
    dense = "write a.b@corp.example or 10.0.0.1 now, " * 20_000
    began = time.perf_counter()
    docs = documents(spark, [(1, dense, None), (2, "a clean one", None)])
    check(pii.personal_data(docs).collect(), {1: dense, 2: "a clean one"})
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean == {1: re.sub("10.0.0.1", "[IP]", dense.replace("a.b@corp.example", "[EMAIL]")), 2: "a clean one"}
    assert time.perf_counter() - began < 90
