import itertools
import random
import re

import xxhash

from tidemark.llm import simhash as sh

from .helpers import CLASHING, ODD, by_id, documents, lower_ascii, read, rows


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, radius=4):
    prints = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for (doc_id, _), p in zip(docs, prints):
        if doc_id is not None:
            least[root(p)] = min(least.get(root(p), doc_id), doc_id)
    return by_id((i, f"{p:016x}", least.get(root(p))) for (i, _), p in zip(docs, prints))


def test_against_brute_force(spark, small):
    got = rows(sh.simhash_components(spark.read.parquet(f"{small}/documents.parquet")))
    assert got == brute(read(small, "documents", "doc_id, text"))
    assert any(r[0] != r[2] for r in got)


def test_odd_rows(spark):
    docs = [r for r in ODD if r[0] not in (6, 9)] + [(12, "word " * 3000 + "end", "en"), (11, "word " * 3001 + "end", "en")]
    assert rows(sh.simhash_components(documents(spark, docs, CLASHING))) == brute([r[:2] for r in docs])
    assert rows(sh.simhash_components(documents(spark, []))) == []


def test_masks_cover_the_radius():
    masks = sh.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        positions = rng.sample(range(64), 4)
        assert any(not any(m >> p & 1 for p in positions) for m in masks)


def planted(seed, n=300):
    """Fingerprints with chains of close ones and a crowd that shares half its bits."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 6):
        fp = rng.getrandbits(64)
        for _ in range(5):
            out.add(fp)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                fp ^= 1 << b
    out |= {(rng.getrandbits(12) << 20) | 0xABC for _ in range(n)}
    return sorted(out)


def test_links_and_blocks(spark):
    """The same components with buckets of any size, crowded ones cut into blocks."""
    prints = planted(5)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, node long")
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    want = {(root(i), i) for i in range(len(prints)) if root(i) != i}
    for most in (4096, 16):
        assert {tuple(r) for r in sh.components(sh.links(nodes, 4, most)).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).selectExpr("id AS a", "id + 1 AS b")
    assert {tuple(r) for r in sh.components(edges).collect()} == {(0, i) for i in range(1, 501)}
