import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from hypothesis import given, strategies as st

from tidemark.llm import warc

from .helpers import by_id, read, rows


def brute(pages):
    first = {}
    for page_id, _, html in pages:
        payload = (html or "").encode()
        if len(payload) >= 100 and page_id is not None:
            first[payload] = min(first.get(payload, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        of = first.get(payload)
        revisit = of is not None and of != page_id
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return by_id(out)


def frame(spark, pages, clashing=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("own") for c in clashing}) if clashing else df


def test_against_brute_force(spark, small):
    assert rows(warc.archived_pages(spark.read.parquet(f"{small}/pages.parquet"))) == brute(read(small, "pages", "page_id, url, html"))


COPY = "<p>the same page, in so many copies that one of them is enough to keep, é 東京</p>" * 2
PAGES = [
    (9, "http://Example.com:80/a?x=1#top", COPY), (3, "https://www.example.com/a?x=1", COPY), (3, "https://www.example.com/a?x=1", COPY), (4, None, COPY),
    (None, "http://example.com/", COPY), (5, "http://b.example.com", None), (6, "http://b.example.com", ""), (7, "", "x" * 99), (8, "no url\r\nWARC-Type: x", "x" * 99),
    (10, "http://[::1]:8080/p", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n"), (11, "http://10.0.0.1/", "y" * 3_000_000), (None, "u://h", "z" * 200), (None, "u://h/é ü", "z" * 200),
]


def test_odd_rows(spark):
    assert rows(warc.archived_pages(frame(spark, PAGES, ("digest", "type", "key", "Refers_To", "of")))) == brute(PAGES)
    assert rows(warc.archived_pages(frame(spark, []))) == []


def test_a_join_in_place_of_a_broadcast_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    assert rows(warc.archived_pages(frame(spark, PAGES))) == brute(PAGES)


def many(n=2000):
    """A third of all captures is of one URL, another of one payload."""
    return [(i, "http://hot.example.com/" if i % 3 == 0 else f"http://h{i % 17}.example.com/p/{i % 101}", COPY if i % 3 == 1 else f"page {i % 400} " * 12) for i in range(n)]


@pytest.mark.parametrize("block_lines, part_lines", [(7, 100), (3000, 300_000), (1, 50)])
def test_lookups_find_all_captures_of_a_url(spark, tmp_path, block_lines, part_lines):
    pages = many()
    path = f"file://{tmp_path}/w"
    captures = warc.write(frame(spark, pages), path, file_bytes=20_000)
    index = warc.build_index(captures, path, block_lines, part_lines)
    assert sum(p.captures for p in index.parts) == len(pages)
    asked = ["http://hot.example.com/#x", "https://www.h3.example.com:443/p/3", "http://h3.example.com/p/3", "http://nobody.example.com/", "http://zzz/", "", None]
    got = rows(index.lookup_urls(spark.createDataFrame([(u,) for u in asked], "url string")).select("page_id"))
    keys = {warc.surt(u) for u in asked}
    assert got == by_id((p[0],) for p in pages if warc.surt(p[1]) in keys)
    every = rows(index.lookup_urls(frame(spark, pages)))
    assert every == rows(captures), "each capture once"


def test_records_come_back_with_their_payloads(spark, tmp_path):
    pages = [p for p in PAGES if p[0] is not None]
    path = f"file://{tmp_path}/w"
    captures = warc.write(frame(spark, pages), path)
    got = {(r.page_id, r.url): r for r in warc.read(captures, path).collect()}
    for page_id, url, html in pages:
        r = got[page_id, None if url is None else warc.escaped(url)]
        assert r.payload is None if r.type == "revisit" else bytes(r.payload) == (html or "").encode()
    of_nine = got[9, "http://Example.com:80/a?x=1#top"]
    assert (of_nine.type, of_nine.refers_to, of_nine.payload_bytes) == ("revisit", 3, len(COPY.encode()))


def test_files_are_archives_that_can_be_scanned(spark, tmp_path):
    captures = warc.write(frame(spark, many(300)), f"file://{tmp_path}/w", file_bytes=10_000)
    files = sorted(p.name for p in Path(tmp_path, "w").iterdir())
    assert len(files) > 8
    text = gzip.decompress(Path(tmp_path, "w", files[0]).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
    assert rows(warc.scan(spark, f"file://{tmp_path}/w", files)) == rows(captures)
    assert rows(warc.scan(spark, f"file://{tmp_path}/w", [])) == []


def test_damage_is_told(tmp_path):
    good = warc.record("response", 1, "http://a/", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parsed(good).payload == b"payload"
    for bad in (good[:-1], good.replace(b"payload\r\n", b"pavload\r\n"), good[4:]):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    with pytest.raises(ValueError):
        list(warc.members([warc.member(good)[:-5]]))


@given(st.lists(st.binary(max_size=50), max_size=8), st.integers(1, 40))
def test_members_of_a_stream_cut_anywhere(contents, step):
    data = b"".join(map(warc.member, contents))
    found = list(warc.members(data[i : i + step] for i in range(0, len(data), step)))
    assert [c for _, _, c in found] == contents
    assert [zlib.decompress(data[o : o + s], 31) for o, s, _ in found] == contents


def test_keys():
    assert warc.surt("http://user@WWW.Example.COM:80/Path?q=1#f") == b"com,example)/Path?q=1"
    assert warc.surt("https://m.example.com:8443") == b"com,example,m:8443)/"
    assert warc.surt("http://10.0.0.1/x") == b"10.0.0.1)/x" and warc.surt("http://www2.org/") == b"org,www2)/"
    assert warc.surt(None) == warc.surt("") == b"" and b"\n" not in warc.surt("a\nb\tc")
