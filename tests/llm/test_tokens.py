import pytest
from hypothesis import given, settings, strategies as st
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_counts as tc

from .helpers import CLASHING, ODD, by_id, documents, read, rows, sha


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def expected(library, docs):
    out = []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return by_id(out)


def test_round_trip_of_all_documents(spark, small, library):
    got = rows(bpe.round_trip(spark.read.parquet(f"{small}/documents.parquet")).drop("token_ids"))
    assert got == expected(library, read(small, "documents", "doc_id, text"))


def test_odd_rows(spark, library):
    assert rows(bpe.round_trip(documents(spark, clashing=("x",))).drop("token_ids")) == expected(library, [r[:2] for r in ODD])
    assert rows(bpe.round_trip(documents(spark, []))) == []


SPECIAL = "<|endoftext|>"
PARTS = st.lists(st.one_of(st.text(max_size=8), st.sampled_from([SPECIAL, "don't", "'s", "'S", "  ", "\n\n", "\t", " 1", "123", "a b", "é", "é", "—", "😀", "　", " x", "\x1c", "<|end", "|>", "東京", " '", "''"])), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=5))
def test_fragments_encode_like_whole_texts(texts):
    whole = Tokenizer.from_file(bpe.tokenizer_path()) if not hasattr(test_fragments_encode_like_whole_texts, "t") else test_fragments_encode_like_whole_texts.t
    test_fragments_encode_like_whole_texts.t = whole
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offsets = bpe.codec(bpe.tokenizer_path()).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_keep_other_columns(spark):
    docs = documents(spark, [(1, "Hello, world!", "en"), (2, None, None)], ("n_words",))
    path = bpe.tokenizer_path()
    out = bpe.decode(bpe.encode(docs, path), path)
    assert out.columns == [*docs.columns, "token_ids", "decoded_text"]
    assert {r.doc_id: r.decoded_text for r in out.collect()} == {1: "Hello, world!", 2: ""}


def test_decode_of_odd_ids(spark):
    ids = spark.createDataFrame([(1, [15496, None, -1, 10**6]), (2, None), (3, []), (4, [167])], "k int, token_ids array<int>")
    out = {r.k: r.decoded_text for r in bpe.decode(ids, bpe.tokenizer_path()).collect()}
    assert out[1] == "Hello" and out[2] is None and out[3] == "" and out[4] == "�"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_and_cache(spark, small, name, tmp_path):
    path = bpe.tokenizer_path(name)
    if name.endswith(".json"):
        own = Tokenizer.from_file(path)
        size = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(pieces.encode(t))
    odd = [r[:2] for r in ODD]
    want = by_id((i, len((t or "").encode()), size(t or "")) for i, t in odd)
    cache = f"file://{tmp_path}/cache"
    assert rows(tc.token_counts(documents(spark, clashing=CLASHING), cache, path)) == want
    stored = rows(spark.read.parquet(cache))
    assert len(stored) == len({t or "" for _, t in odd})
    assert rows(tc.token_counts(documents(spark), cache, path)) == want
    assert rows(spark.read.parquet(cache)) == stored, "hits append nothing"
    assert rows(tc.token_counts(documents(spark, []), cache, path)) == []


def test_counts_of_the_query(spark, small, library):
    got = rows(tc.document_token_counts(spark.read.parquet(f"{small}/documents.parquet")))
    want = []
    for i, t in read(small, "documents", "doc_id, text"):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == by_id(want)


def test_cached_counts_are_used(spark, tmp_path):
    path, cache = bpe.tokenizer_path(), f"file://{tmp_path}/cache"
    docs = documents(spark, [(1, "known", "en"), (2, "new", "en")])
    known = spark.sql("SELECT unhex(sha2('known', 256)) AS content, '%s' AS tokenizer, 99L AS n_tokens" % tc.tokenizer_digest(path))
    known.write.parquet(cache)
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(docs, cache, path).collect()} == {1: 99, 2: 1}


@pytest.mark.parametrize("most", [tc.MAX_BROADCAST, 0])
def test_broadcast_and_shuffled_misses_agree(spark, small, library, tmp_path, most):
    docs, cache = spark.read.parquet(f"{small}/documents.parquet"), f"file://{tmp_path}/cache"
    tc.token_counts(docs.where("doc_id % 3 = 0"), cache, max_broadcast=most).count()
    want = by_id((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in read(small, "documents", "doc_id, text"))
    assert rows(tc.token_counts(docs, cache, max_broadcast=most)) == want
    odd = documents(spark, [(None, "x y", None), (None, "x y", None), (3, None, None), (3, "x y", None)])
    assert rows(tc.token_counts(odd, f"file://{tmp_path}/other", max_broadcast=most)) == by_id([(None, 3, 2), (None, 3, 2), (3, 0, 0), (3, 3, 2)])


def test_doubled_cache(spark, tmp_path):
    path, cache = bpe.tokenizer_path(), f"file://{tmp_path}/cache"
    known = spark.sql("SELECT unhex(sha2('known', 256)) AS content, '%s' AS tokenizer, explode(array(9L, 9L, 7L)) AS n_tokens" % tc.tokenizer_digest(path))
    known.write.parquet(cache)
    docs = documents(spark, [(1, "known", "en"), (2, "known", "en")])
    assert rows(tc.token_counts(docs, cache, path)) == [(1, 5, 7), (2, 5, 7)]


def test_a_warm_cache_encodes_nothing_and_moves_no_text(spark, small, tmp_path, monkeypatch):
    docs, cache = spark.read.parquet(f"{small}/documents.parquet"), f"file://{tmp_path}/cache"
    want, files = rows(tc.token_counts(docs, cache)), sorted(tmp_path.rglob("*.parquet"))
    monkeypatch.setattr(tc, "counter", lambda path: pytest.fail("nothing is missing"))
    warm = tc.token_counts(docs, cache)
    assert rows(warm) == want and sorted(tmp_path.rglob("*.parquet")) == files
    assert "text" not in "".join(x for x in warm._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
