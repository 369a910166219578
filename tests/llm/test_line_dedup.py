from collections import defaultdict

from tidemark.llm import line_dedup as ld

from .helpers import CLASHING, ODD, by_id, documents, lower_ascii, read, rows, sha

BLANK = " \t\n\x0b\x0c\r"


def brute(docs, min_chars=20, min_docs=3):
    """Also for repeated ids: each row is judged alone, a document is an id."""
    key = lambda line: lower_ascii(line.strip(BLANK))
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    frequent = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in frequent or frequent[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return by_id(out)


def test_against_brute_force(spark, small):
    got = rows(ld.line_dedup(spark.read.parquet(f"{small}/documents.parquet")))
    assert got == brute(read(small, "documents", "doc_id, text"))
    assert any(r[2] for r in got)


REPEATED = "  This LINE is in several documents \r"


def test_odd_rows(spark):
    extra = [(i, f"own {i}\n{REPEATED}\n{REPEATED.strip().upper()}\n\n", "en") for i in (20, 21, 22)] + [(None, REPEATED, None), (23, "Ünicode lines ÄÖÜ that are long enough\nx", "de")]
    docs = [*ODD, *extra, *((i, "ünicode lines ÄÖÜ that are long enough", "de") for i in (24, 25, 26)), *((i, "Ünicode Lines ÄÖÜ that are long enough", "de") for i in (27, 28))]
    assert rows(ld.line_dedup(documents(spark, docs, CLASHING))) == brute([r[:2] for r in docs])


def test_kept_lines_keeps_columns(spark):
    out, names = ld.kept_lines(documents(spark, clashing=CLASHING))
    assert names["kept_text"] not in CLASHING and set(CLASHING) <= set(out.columns)
    assert out.count() == len(ODD)
    assert ld.line_dedup(documents(spark, [])).count() == 0


def test_runs_compact_and_answer_anti_joins(spark, tmp_path):
    runs = ld.LineRuns(spark, f"file://{tmp_path}/runs", fanout=2, buckets=4)
    assert runs.frequent(1).count() == 0
    batch = lambda *x: spark.createDataFrame(list(x), "doc_id long, h1 long, h2 long")
    assert runs.unseen(batch((1, 1, 1))).count() == 1
    for i in range(4):
        runs.add(batch((10 * i, 1, 1), (10 * i + 1, i, 2), (10 * i + 1, i, 2)))
    assert [len(x) for x in runs.levels] == [0, 0, 1] and len(runs.repeated) == 3
    held = rows(spark.table(runs.runs()[0]).select("h1", "h2"))
    assert held == [(0, 2), (1, 1), (1, 2), (2, 2), (3, 2)], "a key is in one run only"
    assert rows(runs.frequent(4)) == [(1, 1, 30)] and len(rows(runs.frequent(1))) == 5
    assert rows(runs.unseen(batch((99, 1, 1), (99, 7, 2)))) == [(7, 2, 99)]
    left = spark.catalog.listTables()
    runs.close()
    assert not (tmp_path / "runs").exists() and not spark.catalog.listTables() and left


def test_merges_and_anti_joins_shuffle_no_run(spark, tmp_path):
    """Also when the tables are too small for the planner to care: only sort-merge joins, no exchange."""
    runs = ld.LineRuns(spark, f"file://{tmp_path}/runs", fanout=9, buckets=4)
    for i in range(3):
        runs.add(spark.range(1000).selectExpr("id + %d AS doc_id" % (1000 * i), "id * %d AS h1" % (i + 1), "id AS h2"))
    keys = spark.table(runs.runs()[0])
    plan = runs.unseen(keys)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan
    runs.close()


def test_any_number_of_batches_gives_the_same(spark, small):
    docs, want = spark.read.parquet(f"{small}/documents.parquet"), brute(read(small, "documents", "doc_id, text"))
    for batches, fanout in ((1, 2), (5, 3)):
        out, n = ld.kept_lines(docs, batches=batches, fanout=fanout)
        assert by_id((r.doc_id, r[n["n_lines"]], r[n["n_dropped"]], sha(r[n["kept_text"]])) for r in out.collect()) == want


def test_a_text_of_many_lines_takes_time_in_proportion(spark):
    """200,000 lines, half of them dropped; splitting the text for each line would take hours."""
    import time

    text = "\n".join(f"a line that other documents hold too, number {i // 2}" if i % 2 else f"own {i}" for i in range(200_000))
    docs = [(1, text, "en"), (2, text.replace("own", "any"), "en"), (3, text.replace("own", "some"), "en")]
    want = brute([d[:2] for d in docs])
    began = time.perf_counter()
    assert rows(ld.line_dedup(documents(spark, docs))) == want
    assert time.perf_counter() - began < 60
