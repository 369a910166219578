"""Each stage against a brute-force version on its own input."""

import corpus_pipeline as cp
from tidemark.llm import language_id

from .helpers import by_id, documents, read, rows
from .test_decontaminate import brute as contaminated
from .test_line_dedup import BLANK, lower_ascii
from .test_simhash import brute as components
from .test_tokens import expected, library  # noqa: F401


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_whole_pipeline(spark, small, library):  # noqa: F811
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    found, names = language_id.predict(docs, language_id.trained(docs))
    known = {r.doc_id: r[names["lead"]] for r in found.collect()}
    named = rows(first := cp.identify(spark, docs, small))
    assert first.columns == columns
    want = [r for r in read(small, "documents", ", ".join(columns)) if known[r[0]] is not None and known[r[0]] >= cp.LEAST_LEAD]
    assert named == by_id(want) and len(named) >= 0.9 * len(known)

    lined = rows(second := cp.dedup_lines(spark, first, small))
    assert second.columns == columns
    i, t, n = (columns.index(c) for c in ("doc_id", "text", "n_chars"))
    key = lambda x: lower_ascii(x.strip(BLANK))
    holders = {}
    for r in named:
        for line in r[t].split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(r[i])
    gone = lambda r, x: len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != r[i]
    for r in (want := [list(r) for r in named]):
        lines = r[t].split("\n")
        kept = [x for x in lines if not gone(r, x)]
        if len(kept) < len(lines):
            r[t] = "\n".join(kept)
            r[n] = len(r[t])
    assert lined == by_id(map(tuple, want))

    single = rows(third := cp.dedup_near(spark, second, small))
    assert third.columns == columns
    least = {doc: comp for doc, _, comp in components([(r[i], r[t]) for r in lined])}
    assert single == by_id(r for r in lined if least[r[i]] == r[i])

    clean = rows(fourth := cp.drop_contaminated(spark, third, small))
    assert fourth.columns == columns
    bad = {r[0] for r in contaminated([(r[i], r[t]) for r in single], read(small, "benchmark", "item_id, text")) if r[-1]}
    assert bad and clean == by_id(r for r in single if r[i] not in bad)

    assert rows(cp.run(spark, small).drop("token_ids")) == expected(library, [(r[i], r[t]) for r in clean])


def test_odd_rows_and_extra_columns(spark, tmp_path):
    from .helpers import CLASHING, ODD

    bench = f"file://{tmp_path}"
    spark.createDataFrame([("a", None)], "item_id string, text string").write.parquet(f"{bench}/benchmark.parquet")
    for data in (ODD, []):
        docs = documents(spark, data, CLASHING)
        for name, stage in cp.STAGES:
            out = stage(spark, docs, bench)
            assert name == "bpe" or out.columns == docs.columns
            out.count()
