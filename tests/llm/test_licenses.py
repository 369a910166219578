import os

import pytest

from tidemark.llm import licenses as lc

from .helpers import CLASHING, ODD, documents


def scan(spark, rows, clashing=()):
    return {r.doc_id: r for r in lc.license_scan(documents(spark, rows, clashing)).collect()}


def test_equivalent_texts(spark):
    shouted = "Copyright (c) 2020 Somebody\n\n" + lc.MIT.upper().replace(",", " ,").replace('"', "“")
    british = lc.APACHE2_HEADER.replace("License", "Licence").replace("http:", "https:")
    got = scan(spark, [(1, shouted, "en"), (2, british, "en"), (3, lc.MIT + " and more", "en"), (4, "Intro\n  released under THE mit licence!\nend", "en"), (5, lc.BSD2, "en"), (6, lc.BSD3, "en")])
    assert [got[i].license_id for i in range(1, 7)] == ["MIT", "Apache-2.0", None, None, "BSD-2-Clause", "BSD-3-Clause"]
    assert got[4].notices == "MIT" and got[4].n_notices == 1


def test_odd_rows(spark):
    got = lc.license_scan(documents(spark, ODD, CLASHING)).collect()
    assert len(got) == len(ODD) and all(r.license_id is None and r.notices == "" and r.n_notices == 0 for r in got)
    assert lc.license_scan(documents(spark, [])).collect() == []


def test_letters_beyond_ascii_differ(spark):
    got = scan(spark, [(1, "Лицензия один", "ru"), (2, "Лицензия два", "ru"), (3, "", "en")])
    assert len({r.text_sha256 for r in got.values()}) == 3


@pytest.mark.parametrize(
    "head",
    ["# Copyright (c) 2020 A\n", " * Copyright 2020 A\n", "// Copyright Acme Inc. 2020\n", "\u00a0© Acme\n", "/* (C) 2019-2021 A, B */\n", "Copyright (c) 2020, A\r\nAll rights reserved.\r\n", "All Rights Reserved\n", "\ufeffMIT\u00a0License\n\nCopyright © A <a@b.c>\nCopyright 2021 C\n\n", "-- copyright: (c) 1999 A\n--\n"],
)
def test_ordinary_heads_of_licences(spark, head):
    body = lc.MIT if "--" in head else "\n".join(" * " + x for x in lc.MIT.split("\n"))
    got = scan(spark, [(1, head + body, "en"), (2, head.replace("Copyright", "Copy right") + "not " + body, "en")])
    assert got[1].license_id == "MIT" and got[2].license_id is None


def test_lines_of_the_text_that_speak_of_copyright_stay(spark):
    text = "copyright notice and this permission notice\nall rights reserved to the owner"
    got = scan(spark, [(1, text, "en"), (2, text.split("\n")[0], "en"), (3, text.split("\n")[1], "en"), (4, "", "en")])
    assert len({r.text_sha256 for r in got.values()}) == 4


FILES = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the system has no licence files")
def test_digests_of_entire_texts(spark):
    texts = {i: open(f"/usr/share/common-licenses/{f}").read() for i, f in FILES.items()}
    docs = [(k, "\n".join("# " + x for x in t.split("\n")), i) for k, (i, t) in enumerate(texts.items())]
    assert {r.doc_id: r.license_id for r in lc.license_scan(documents(spark, docs)).collect()} == {k: i for k, _, i in docs}


def test_a_table_of_the_callers_own(spark):
    known = spark.createDataFrame([("Ours", "Use this as you like."), ("B-Ours", "USE THIS, AS YOU LIKE"), ("Sub", "Sublicense it"), (None, "null"), ("Empty", None)], "license_id string, text string")
    docs = documents(spark, [(1, "use this as you like", "en"), (2, "x\n## Sub-licence it!\nnull", "en"), (3, lc.MIT, "en"), (4, None, None)])
    for most in (lc.MAX_KNOWN, 0):
        got = {r.doc_id: r for r in lc.license_scan(docs, known, most).collect()}
        assert [got[i].license_id for i in (1, 2, 3, 4)] == ["B-Ours", None, None, None] and got[2].notices == "Sub" and got[2].n_notices == 1


def test_first_words_lose_no_line(spark):
    """Every known text as a line, in other spellings, passes the test of its first word."""
    texts = [(i, "\u2022 " + t.replace("\n", " ").replace("icense", "icence").upper(), n) for i, (n, t) in enumerate(lc.KNOWN)]
    got = {r.doc_id: r.notices for r in lc.license_scan(documents(spark, texts)).collect()}
    assert got == {i: n for i, _, n in texts}
